import random
from collections import Counter

import pyarrow as pa

from millrace.llm import frequent as f

SCHEMA = "k STRING, item STRING, n INT"


def frame(spark, values):
    return spark.createDataFrame([(v, "x", 1) for v in values], SCHEMA)


def values(seed=6):
    rng = random.Random(seed)
    out = ["hot"] * 3000 + ["warm"] * 500 + ["", None] * 400 + [f"r{rng.randrange(4000)}" for _ in range(5000)] + ["ä"] * 60
    rng.shuffle(out)
    return out


def top(data, k):
    return sorted(Counter(v for v in data if v).items(), key=lambda x: (-x[1], x[0]))[:k]


def test_above_a_share(spark):
    data = values()
    for most in (1 << 20, 40):
        got = {r.item: r.n for r in f.items_above(frame(spark, data).repartition(5), "k", 0.05, most=most).collect()}
        want = {i: n for i, n in Counter(v for v in data if v).items() if n >= 0.05 * len(data)}
        assert got == want and set(want) == {"hot", "warm"}


def test_exactly_the_share_counts(spark):
    data = ["a"] * 5 + ["b"] * 4 + [None] * 91
    assert [tuple(r) for r in f.items_above(frame(spark, data), "k", 0.05).collect()] == [("a", 5)]


def test_top(spark):
    data = values()
    for most in (1 << 20, 60):
        assert [tuple(r) for r in f.top_items(frame(spark, data).repartition(4), "k", 3, most=most).collect()] == top(data, 3)
    # flat and sorted: an item may be rare on every node, and ties go to the smaller item
    flat = [f"{i:04d}" for i in range(900)] * 2
    assert [tuple(r) for r in f.top_items(frame(spark, flat).repartition(6), "k", 5, most=50).collect()] == top(flat, 5)
    assert [tuple(r) for r in f.top_items(frame(spark, ["b", "a", "a"]), "k", 10).collect()] == [("a", 2), ("b", 1)]


def test_empty(spark):
    for data in ([], [None, ""]):
        assert f.items_above(frame(spark, data), "k", 0.1).collect() == [] and f.top_items(frame(spark, data), "k", 3).collect() == []


def test_local_counts_never_lose_more_than_the_error():
    local, data = f.LocalCounts(20), values(9)
    for i in range(0, len(data), 500):
        local.add(pa.array(data[i : i + 500], pa.string()))
    table = local.counts()
    counts = dict(zip(table["item"].to_pylist(), table["n"].to_pylist()))
    assert local.rows == len(data) and 0 < local.error and len(counts) == table.num_rows <= 20
    for item, n in Counter(v for v in data if v).items():
        assert n - local.error <= counts.get(item, 0) <= n


def test_candidates_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(f, "if_small", lambda *_, **__: None)
    data = values()
    assert [tuple(r) for r in f.top_items(frame(spark, data).repartition(4), "k", 3).collect()] == top(data, 3)
    assert [tuple(r) for r in f.top_items(frame(spark, data).repartition(4), "k", 3, most=60).collect()] == top(data, 3)
    assert {r.item for r in f.items_above(frame(spark, data), "k", 0.05).collect()} == {"hot", "warm"}
