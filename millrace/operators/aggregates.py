"""Keyed aggregates; all combine before the shuffle except ``collect_by``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_sum(number: Column, scale: int = 2) -> Column:
    """A sum that doesn't depend on order: in decimals of the given scale, returned as DOUBLE.
    No numbers sum to 0."""
    return F.coalesce(F.sum(number.cast(f"decimal(28,{scale})")).cast("double"), F.lit(0.0))


def exact_avg(number: Column, scale: int = 2) -> Column:
    """Null for a group without numbers."""
    return F.sum(number.cast(f"decimal(28,{scale})")).cast("double") / F.nullif(F.count(number), F.lit(0))


def count_by(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def sum_by(df: DataFrame, keys: Sequence[str | Column], number: Column, name: str = "total", scale: int = 2) -> DataFrame:
    return df.groupBy(*keys).agg(exact_sum(number, scale).alias(name))


def multi_agg(df: DataFrame, keys: Sequence[str | Column], **aggregates: Column) -> DataFrame:
    """Several aggregates in one pass, named by keyword."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def collect_by(df: DataFrame, keys: Sequence[str | Column], value: Column, name: str = "items") -> DataFrame:
    """All values of a key, sorted. The group must fit in a task: it is the result."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(name))
