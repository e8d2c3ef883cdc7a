import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from millrace.operators import references as r

PAGES = "pageurl STRING, listed_on DATE, removed_on DATE, url STRING, day DATE"
REFS = "id BIGINT, link STRING, at DATE, url STRING, day STRING, refs INT"


def brute(pages, refs):
    out = set()
    for i, url, day, *_ in refs:
        if not url:
            continue
        own = [(a, b) for u, a, b, *_ in pages if u == url and not (b and a and b <= a)]
        if not any(day is None or ((a is None or a <= day) and (b is None or day < b)) for a, b in own):
            out.add(("t", day.strftime("%Y-%m") if day else "none", i))
    return out


def run(spark, pages, refs):
    p, q = spark.createDataFrame(pages, PAGES), spark.createDataFrame(refs, REFS)
    return r.references(q, "t", F.col("link"), "at", "id"), p


def test_random(spark):
    rng = random.Random(7)
    day = lambda: None if rng.random() < 0.1 else date(2000, 1, 1) + timedelta(rng.randrange(60))
    url = lambda: rng.choice([None, "", "hot", "hot", "a", "b", "c", "ä"])
    pages = [(url(), day(), day(), "x", None) for _ in range(12)]
    refs = [(i, url(), day(), None, None, 1) for i in range(400)]
    q, p = run(spark, pages, refs)
    want = brute(pages, refs)
    assert {tuple(x) for x in r.orphans(q, p).collect()} == want
    assert {tuple(x) for x in r.orphans(q, p, most=0).collect()} == want
    report = {(x.src, x.period): x.orphans for x in r.orphan_report(q, p).collect()}
    assert sum(report.values()) == len(want)
    for (src, period), n in report.items():
        assert n == sum(1 for w in want if w[:2] == (src, period))


def test_boundaries_and_repeats(spark):
    d = date(2000, 1, 10)
    pages = [("a", d, d + timedelta(5), "", None), ("a", d, d + timedelta(5), "", None), ("e", d, d, "", None)]
    refs = [(1, "a", d - timedelta(1), "", "", 0), (2, "a", d, "", "", 0), (3, "a", d + timedelta(4), "", "", 0), (4, "a", d + timedelta(5), "", "", 0), (4, "a", d + timedelta(5), "", "", 0), (5, "e", d, "", "", 0), (6, "e", None, "", "", 0), (7, "a", None, "", "", 0)]
    q, p = run(spark, pages, refs)
    assert sorted(x.row_id for x in r.orphans(q, p).collect()) == [1, 4, 4, 5, 6]


def test_states_add_up_day_by_day(spark, tmp_path):
    """Deltas of each day, withdrawals among them, on a state that is stored and read again, against a rebuild."""
    rng = random.Random(11)
    day = lambda: None if rng.random() < 0.1 else date(2000, 1, 1) + timedelta(rng.randrange(30))
    pages, refs, place = [], [], None
    for step in range(5):
        new_pages = [(rng.choice("abcd"), day(), day(), "", None) for _ in range(3)]
        new_refs = [(rng.choice("st"), rng.choice("abcdefgh"), day()) for _ in range(40)]
        gone_pages, gone_refs = rng.sample(pages, len(pages) // 3), rng.sample(refs, len(refs) // 2)
        frame = lambda rows: r.reference_deltas(spark.createDataFrame(rows, "src STRING, url STRING, day DATE"), 1)
        deltas = [frame(new_refs), r.listing_deltas(spark.createDataFrame(new_pages, PAGES))]
        # a withdrawal may come before or with what it withdraws
        deltas += [r.reference_deltas(spark.createDataFrame(gone_refs, "src STRING, url STRING, day DATE"), -1), r.listing_deltas(spark.createDataFrame(gone_pages, PAGES), sign=-1)]
        state = r.apply_deltas(deltas[2], *deltas[:2], deltas[3]) if place is None else r.apply_deltas(spark.read.parquet(place), *deltas)
        place = f"{tmp_path}/{step}"
        state.write.parquet(place)
        for x in gone_pages:
            pages.remove(x)
        for x in gone_refs:
            refs.remove(x)
        pages, refs = pages + new_pages, refs + new_refs
        rows = [(i, url, at, None, None, 1) for i, (_, url, at) in enumerate(refs)]
        want = {}
        for _, period, i in brute(pages, rows):
            want.setdefault((refs[i][0], period), []).append(refs[i][1])
        got = {(x.src, x.period): (x.orphans, x.urls) for x in r.report(spark.read.parquet(place)).collect()}
        assert got == {k: (len(v), len(set(v))) for k, v in want.items()}
    nothing = r.apply_deltas(spark.read.parquet(place), frame(refs).withColumn("refs", -F.col("refs")), r.listing_deltas(spark.createDataFrame(pages, PAGES), sign=-1))
    assert nothing.collect() == []


def test_empty(spark):
    q, p = run(spark, [], [])
    assert r.orphans(q, p).collect() == [] and r.orphan_report(q, p).collect() == []
    q, p = run(spark, [], [(1, "a", None, "", "", 1)])
    assert [tuple(x) for x in r.orphans(q, p).collect()] == [("t", "none", 1)]
