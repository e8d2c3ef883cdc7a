"""Percentiles of very large columns from mergeable sketches with bounded rank error.

Sketches are randomized compactor hierarchies (KLL, Spark's own aggregates): each level
sorts its buffer and passes every other value up, merging goes level by level. A day's
partial sketch per group is kept as bytes; sketches of any days or partitions add up in
any order. Everything stays in the JVM, and a hot group travels as one sketch per day.

With ``size`` k the ranks of all answers from a sketch are off by at most 2.446 / k**0.9433 of
the group's rows with 99 % confidence (the published fit for many percentiles of one
sketch); groups of at most k rows are exact. ``bounds_hold`` counts the true ranks. Defined results: null, NaN and infinite values don't count; a null
group is a group, a null day a day; groups without values have no row; ties and repeated
rows count as stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import if_small

SIZE = 800


def rank_error(size: int = SIZE) -> float:
    return 2.446 / size**0.9433


def partial_sketches(df: DataFrame, group: Column, day: Column, value: Column, size: int = SIZE) -> DataFrame:
    """(grp, day, sketch): one sketch per group and day."""
    v = value.cast("double")
    rows = df.select(group.alias("grp"), day.alias("day"), v.alias("v")).where(F.abs("v") < float("inf"))
    return rows.groupBy("grp", "day").agg(F.kll_sketch_agg_double("v", size).alias("sketch"))


def merged_sketches(sketches: DataFrame, size: int = SIZE) -> DataFrame:
    """(grp, sketch) of all partial sketches of each group."""
    return sketches.groupBy("grp").agg(F.kll_merge_agg_double("sketch", size).alias("sketch"))


def _name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


PROBS = (0.25, 0.5, 0.75, 0.9, 0.99)


def percentiles(sketches: DataFrame, probs: Sequence[float] = PROBS, size: int = SIZE) -> DataFrame:
    """(grp, n, p25, p50, ..., rank_error)."""
    answers = F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, map(float, probs))))
    named = [F.col("a")[i].alias(_name(p)) for i, p in enumerate(probs)]
    n = F.kll_sketch_get_n_double("sketch").alias("n")
    bound = F.when(F.col("n") > size, rank_error(size)).otherwise(0.0).alias("rank_error")
    return sketches.select("grp", n, answers.alias("a")).select("grp", "n", *named, bound)


def bounds_hold(df: DataFrame, group: Column, value: Column, answers: DataFrame, probs: Sequence[float] = PROBS) -> DataFrame:
    """(grp, n, within): the exact number of values of each group, and whether each answer of
    ``percentiles`` has a rank within its error. One pass over the values; a group's counts
    combine before the shuffle. The answers are broadcast if they are few."""
    v = value.cast("double")
    rows = df.select(F.struct(group.alias("g")).alias("key"), v.alias("v")).where(F.abs("v") < float("inf"))
    kept = answers.select(F.struct(F.col("grp").alias("g")).alias("key"), "rank_error", *map(_name, probs))
    sent = if_small(kept, F.col("key").cast("string"))
    met = rows.join(kept if sent is None else sent, "key", "left")
    counts = []
    for p in probs:
        counts += [F.count(F.when(F.col("v") < F.col(_name(p)), 1)).alias(f"low_{_name(p)}"), F.count(F.when(F.col("v") <= F.col(_name(p)), 1)).alias(f"high_{_name(p)}")]
    per_group = met.groupBy("key").agg(F.count("*").alias("n"), F.max("rank_error").alias("e"), *counts)
    fine = F.lit(True)
    for p in probs:
        slack = (F.col("e") + 1e-12) * F.col("n")
        fine = fine & (F.col(f"low_{_name(p)}") - slack <= F.col("n") * p) & (F.col("n") * p <= F.col(f"high_{_name(p)}") + slack)
    return per_group.select(F.col("key.g").alias("grp"), "n", F.coalesce(fine, F.lit(False)).alias("within"))
