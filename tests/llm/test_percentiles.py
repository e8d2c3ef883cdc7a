import random

from pyspark.sql import functions as F

from millrace.llm import percentiles as p

SCHEMA = "g STRING, day INT, v DOUBLE, sketch INT, grp INT, n INT"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def run(df, size=p.SIZE, probs=(0.25, 0.5, 0.75, 0.9, 0.99)):
    daily = p.partial_sketches(df, F.col("g"), F.col("day"), F.col("v"), size)
    return {r.grp: r for r in p.percentiles(p.merged_sketches(daily, size), probs, size).collect()}


def test_rank_error_is_bounded(spark):
    rng = random.Random(4)
    rows = [("hot", rng.randrange(50), rng.lognormvariate(0, 3)) for _ in range(30_000)] + [("ties", i % 9, float(i % 5)) for i in range(5000)]
    got = run(frame(spark, rows), size=200)
    for g, r in got.items():
        v = sorted(x for k, _, x in rows if k == g)
        for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (0.99, "p99")):
            low, high = sum(x < r[name] for x in v) / len(v), sum(x <= r[name] for x in v) / len(v)
            assert low - r.rank_error <= q <= high + r.rank_error
        assert r.n == len(v)


def test_small_groups_are_exact_and_days_add_up(spark):
    rows = [("a", d, float(i)) for d in range(5) for i in range(d, 100, 5)]
    r = run(frame(spark, rows))["a"]
    assert (r.n, r.p50, r.p90, r.rank_error) == (100, 49.0, 89.0, 0.0)
    one = p.partial_sketches(frame(spark, rows).where("day < 3"), F.col("g"), F.col("day"), F.col("v"))
    two = p.partial_sketches(frame(spark, rows).where("day >= 3"), F.col("g"), F.col("day"), F.col("v"))
    kept = p.merged_sketches(one).unionByName(p.merged_sketches(two).select("grp", "sketch"))
    assert p.percentiles(p.merged_sketches(kept)).first().p50 == 49.0


def test_what_does_not_count(spark):
    inf = float("inf")
    rows = [("x", 1, None), ("x", 1, float("nan")), ("x", None, inf), ("x", 2, -inf), (None, None, 3.0), (None, 1, 3.0), ("y", 1, -5.0)]
    got = run(frame(spark, rows))
    assert {g: (r.n, r.p50) for g, r in got.items()} == {None: (2, 3.0), "y": (1, -5.0)}
    assert run(frame(spark, [])) == {}


def test_bounds_are_checked_against_true_ranks(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(9), rng.choice([rng.gauss(0, 1), 2.0, float("nan")])) for _ in range(9000)]
    df = frame(spark, rows)
    answers = p.percentiles(p.merged_sketches(p.partial_sketches(df, F.col("g"), F.col("day"), F.col("v"), 200), 200), size=200)
    answers = spark.createDataFrame(answers.collect(), answers.schema)
    check = lambda a: {r.grp: (r.n, r.within) for r in p.bounds_hold(df, F.col("g"), F.col("v"), a).collect()}
    want = {g: sum(1 for k, _, v in rows if k == g and v == v) for g in ("a", "b", None)}
    assert check(answers) == {g: (n, True) for g, n in want.items()}
    # a spoilt or missing answer is noticed
    assert check(answers.withColumn("p50", F.when(F.col("grp") == "a", F.col("p50") + 1).otherwise(F.col("p50")))) == {g: (n, g != "a") for g, n in want.items()}
    assert check(answers.where("grp IS NOT NULL")) == {g: (n, g is not None) for g, n in want.items()}
    assert p.bounds_hold(df.limit(0), F.col("g"), F.col("v"), answers).collect() == []
