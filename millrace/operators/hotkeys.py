"""Per-key results where a handful of keys hold most rows.

Counts and sums combine before the shuffle, so a hot key travels as one row per
input partition. Quantiles per key are exact: value histograms are refined level by
level. A value is cut into 16-bit digits of its order-preserving 64-bit image; each
level counts the digits below the prefixes chosen so far (mergeable counts, always
combined before they are shuffled, at most 65,536 rows per prefix and partition), a
running sum finds the digit that holds the wanted rank, and only keys not resolved
yet go on. A digit whose least and greatest value are equal resolves at once, and four
levels always suffice. Open prefixes are broadcast if they are few (``session.if_small``);
else all digits of the level are counted and the counts, not the rows, are joined with
them. The values of a key are never gathered: no row is shuffled uncombined.

Defined results: null keys are keys and the empty text is one; values that aren't finite
numbers count as rows but not as numbers; ties have one rank each, -0 counts as 0; repeated
rows count as stored; empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.operators.malformed import strict_cast
from millrace.session import if_small, release, written

_DIGIT = 16
_LEVELS = 4


def numeric(text: Column) -> Column:
    """The finite number a text holds in plain or E notation with ASCII digits and no blanks, else null."""
    return strict_cast(text, "double")


@F.pandas_udf(T.LongType())
def _image(x: pd.Series) -> pd.Series:
    """Doubles to integers of the same order (-0.0 as 0.0)."""
    bits = (x.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(T.DoubleType())
def _preimage(x: pd.Series) -> pd.Series:
    bits = x.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64))


def key_totals(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Per key: rows, numeric rows and the sum of numeric values. Sums are taken as
    DECIMAL(38,12) of the text, so their order doesn't matter; a key with a number of 1e20
    or more, or whose sum leaves that type, sums in doubles, in any order. A null key is a
    key; a key without numbers sums to 0."""
    v = numeric(value)
    wide = F.max(F.abs(v)) >= 1e20
    exact = F.try_sum(F.when(F.abs(v) < 1e20, value.try_cast("decimal(38,12)"))).cast("double")
    total = F.coalesce(F.when(~wide, exact), F.sum(v), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count(v).alias("n_numbers"), total.alias("total"))


def dominant_keys(df: DataFrame, group: Sequence[str], keys: Sequence[str], share: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """Keys that hold at least ``share`` of the rows of their group, with the columns ``by``
    (a key's rows may differ in them: each value is reported). Null groups and keys
    count as values. Counts combine before both shuffles."""
    part = Fraction(repr(share))  # 0.1 means a tenth, not the nearest double
    counts = df.groupBy(*group, *keys, *by).agg(F.count("*").alias("__n"))
    per_key = counts.groupBy(*group, *keys).agg(F.sum("__n").alias("__n"), *[F.collect_set(F.struct(c)).alias(f"__s_{c}") for c in by])
    per_group = per_key.groupBy(*[F.col(g).alias(f"__g_{g}") for g in group]).agg(F.sum("__n").alias("__all"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group])
    top = per_key.join(per_group, same).where(F.col("__n") * part.denominator >= F.col("__all") * part.numerator)
    for c in by:
        top = top.withColumn(f"__s_{c}", F.explode(f"__s_{c}")).withColumn(c, F.col(f"__s_{c}.{c}"))
    return top.select(*group, *by, *keys)


def _rank(n: str, prob: float) -> Column:
    """``max(1, ceil(prob * n))`` in integers; 0.1 means a tenth, not the nearest double."""
    part = Fraction(repr(prob))
    if not 0 <= part <= 1 or part.denominator > 10**18:
        raise ValueError(f"{prob} isn't a probability of at most 18 decimals")
    over = f"CAST({n} AS DECIMAL(19,0)) * CAST({part.numerator} AS DECIMAL(19,0)) + {part.denominator - 1}BD"
    return F.greatest(F.lit(1).cast("bigint"), F.expr(f"({over}) div {part.denominator}BD"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column, probs: Sequence[float] = (0.5, 0.9), few: int | None = None) -> DataFrame:
    """(keys, n_numbers, prob, quantile): for each key and probability the value of rank
    ``max(1, ceil(prob * n))`` among the key's numbers; keys without numbers have no row.
    NaN and infinities aren't numbers; null keys are keys. At most ``few`` open prefixes
    are broadcast (by default ``session.if_small`` decides)."""
    # a struct of nulls is no null, so plain equality serves joins and groups alike
    whole = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    base = df.select(whole.alias("__k"), value.alias("__v")).where("__v IS NOT NULL AND abs(__v) < double('Infinity')")
    data = written(base.withColumn("__b", _image("__v")).drop("__v"), "numbers")
    limits = {} if few is None else {"rows": few}

    def prefix(level: int) -> Column:
        return F.shiftright("__b", 64 - _DIGIT * (level + 1))

    open_, done = None, []
    for level in range(_LEVELS):
        rows, wanted, parents = data.withColumn("__digit", prefix(level)), None, []
        if open_ is not None:
            parents = ["__parent"]
            wanted = open_.select("__k", "__parent").distinct()
            rows = rows.withColumn("__parent", prefix(level - 1))
            if (sent := if_small(wanted, F.col("__k").cast("string"), **limits)) is not None:
                rows = rows.join(sent, ["__k", "__parent"], "left_semi")
                wanted = None
        # the digit is the whole prefix with it, so it names its parent
        hist = rows.groupBy("__k", *parents, "__digit").agg(F.count("*").alias("__n"), F.min("__b").alias("__lo"), F.max("__b").alias("__hi"))
        if wanted is not None:
            hist = hist.join(wanted, ["__k", "__parent"], "left_semi")
        # at most 65,536 rows under a prefix
        under = Window.partitionBy("__k", *parents)
        hist = hist.withColumn("__upto", F.sum("__n").over(under.orderBy("__digit")))
        if open_ is None:
            ranks = [F.struct(F.lit(float(p)).alias("prob"), _rank("__total", p).alias("rank")) for p in probs]
            found = hist.withColumn("__total", F.sum("__n").over(under)).withColumn("__r", F.explode(F.array(*ranks))).withColumn("__prob", F.col("__r.prob")).withColumn("__rank", F.col("__r.rank"))
        else:
            found = hist.join(open_.drop("__lo", "__hi"), ["__k", "__parent"]).drop("__parent")
        held = found.where("__rank <= __upto AND __rank > __upto - __n")
        held = written(held.select("__k", F.col("__digit").alias("__parent"), "__prob", (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__rank"), "__total", "__lo", "__hi"), f"level{level}")
        done.append(held.where("__lo = __hi").select("__k", "__total", "__prob", "__lo"))
        open_ = held.where("__lo < __hi")
        if level == _LEVELS - 1 or open_.isEmpty():
            break
    release(data)
    out = reduce(DataFrame.unionAll, done)
    return out.select(*[F.col(f"__k.k{i}").alias(k) for i, k in enumerate(keys)], F.col("__total").alias("n_numbers"), F.col("__prob").alias("prob"), _preimage("__lo").alias("quantile"))
