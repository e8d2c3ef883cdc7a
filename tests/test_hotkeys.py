import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.operators import hotkeys as h

SCHEMA = "job BIGINT, key STRING, bin BIGINT, value STRING, __n INT, __v INT"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("few", [None, 0])
def test_quantiles_equal_sorting(spark, few):
    rng = random.Random(3)
    rows = [(1, "hot", 0, repr(rng.lognormvariate(0, 20) * rng.choice([-1, 1]))) for _ in range(3000)]
    rows += [(1, "near", 0, repr(1.0 + i * 2.0**-52)) for i in range(300)] + [(1, "same", 0, "5")] * 50
    rows += [(None, None, 0, x) for x in ("1", "n/a", None, "NaN", "1e400", "-0", "0", "1e308", "-1e308", "5e-324", "１")]
    rows += [(rng.randrange(3), rng.choice(["", "ä", "b"]), 0, str(rng.randrange(5))) for _ in range(200)] + [(2, "none", 0, "x")]
    probs = (0.0, 1e-7, 0.5, 0.9, 0.9999999, 1.0)
    got = {(r.job, r.key, r.prob): (r.quantile, r.n_numbers) for r in h.exact_quantiles(frame(spark, rows), ["job", "key"], h.numeric(F.col("value")), probs, few).collect()}
    groups = {}
    for job, key, _, v in rows:
        if v is not None and v.isascii() and v not in ("n/a", "NaN", "1e400", "x"):
            groups.setdefault((job, key), []).append(float(v))
    want = {(*k, p): (sorted(v)[max(1, math.ceil(Fraction(repr(p)) * len(v))) - 1], len(v)) for k, v in groups.items() for p in probs}
    assert got == want


@pytest.mark.parametrize("n, p, want", [(10**11, 0.9, 9 * 10**10), (10**18, 0.9999999, 10**18 - 10**11), (9 * 10**18, 0.5, 45 * 10**17), (10**7 + 1, 1e-7, 2), (7, 0.0, 1), (2**63 - 1, 1.0, 2**63 - 1), (10**18, 0.30000000000000004, 300000000000000040)])
def test_ranks_are_exact(spark, n, p, want):
    assert spark.range(1).select(F.lit(n).cast("bigint").alias("n")).select(h._rank("n", p)).first()[0] == want


def test_impossible_probabilities_are_refused():
    for p in (-0.1, 1.5, 1e-30):
        with pytest.raises(ValueError):
            h._rank("n", p)


@pytest.mark.parametrize("few", [None, 0])
def test_no_row_is_shuffled_uncombined(spark, monkeypatch, few):
    """Below every exchange of values lies a partial aggregate, or a join or window of combined counts."""
    plans = []
    keep = h.written

    def planned(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, label)

    monkeypatch.setattr(h, "written", planned)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        h.exact_quantiles(frame(spark, [(1, "hot", 0, repr(1 + i / 2**40)) for i in range(2000)]), ["key"], h.numeric(F.col("value")), (0.5,), few).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    levels = [text for label, text in plans if label.startswith("level")]
    assert len(levels) > 1 and "Exchange" not in plans[0][1]
    for text in levels:
        above, scans = [], 0
        for line in text.split("\n"):
            depth = re.search(r"[A-Za-z]", line + "x").start()
            above = [(d, x) for d, x in above if d < depth] + [(depth, line)]
            if "FileScan" in line and "__b#" in line:
                scans += 1
                first = next(x for _, x in reversed(above) if "HashAggregate" in x or "Exchange hash" in x)
                assert "partial_count" in first
        assert scans == 1


def test_dominant(spark):
    rows = [(1, "a", 0, "")] * 8 + [(1, "", 1, "")] * 2 + [(1, "c", 2, "")] * 9 + [(1, None, 3, "")] + [(2, f"k{i}", i, "") for i in range(11)] + [(None, "x", None, "")]
    got = {tuple(r) for r in h.dominant_keys(frame(spark, rows), ["job"], ["key"], 0.1, by=["bin"]).collect()}
    assert got == {(1, 0, "a"), (1, 1, ""), (1, 2, "c"), (None, None, "x")}


def test_totals(spark):
    rows = [(1, "a", 0, v) for v in ("1", "0.1", "0.2", "1 ", "", None, "1e-3", "1\n", "{}", "NaN")] + [(1, "big", 0, "1e300"), (1, "big", 0, "1"), (None, None, 0, None)]
    rows += [(1, "sum", 0, "9" * 20 + ".0")] * 3 + [(1, "over", 0, "9.9e19")] * 20
    got = {r.key: (r.n_rows, r.n_numbers, r.total) for r in h.key_totals(frame(spark, rows), ["job", "key"], F.col("value")).collect()}
    assert got.pop("sum") == (3, 3, 3e20) and got.pop("over") == (20, 20, 1.98e21)
    assert got == {"a": (10, 4, 1.301), "big": (2, 2, 1e300), None: (1, 0, 0.0)}


def test_sums_beyond_the_decimal_are_taken_in_doubles(spark):
    df = spark.range(1_100_000).select(F.lit("k").alias("key"), F.lit("9.9e19").alias("value"))
    r = h.key_totals(df, ["key"], F.col("value")).first()
    assert (r.n_numbers, round(r.total / 1.089e26, 9)) == (1_100_000, 1.0)


def test_empty(spark):
    e = frame(spark, [])
    assert h.exact_quantiles(e, ["key"], h.numeric(F.col("value"))).collect() == []
    assert h.dominant_keys(e, ["job"], ["key"], by=["bin"]).collect() == [] and h.key_totals(e, ["key"], F.col("value")).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_does_not_matter(spark, parts):
    rows = [(1, "a", 0, str(i % 97)) for i in range(1000)]
    df = frame(spark, rows).repartition(parts)
    assert h.exact_quantiles(df, ["key"], h.numeric(F.col("value")), (0.5,)).first().quantile == sorted(i % 97 for i in range(1000))[499]
