"""Placement of rows on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_partition(df: DataFrame, bins: int, *keys: str) -> DataFrame:
    """Equal keys in one partition, by Spark's own hash."""
    return df.repartition(bins, *keys)


def custom_partition(df: DataFrame, bins: int, place: Column) -> DataFrame:
    """Rows in exactly the partition ``place`` names; a value outside 0..bins-1 is an error,
    null goes to partition 0."""
    checked = F.when(place.isNull(), 0).when((place >= 0) & (place < bins), place).otherwise(F.raise_error(F.concat(F.lit("no such partition: "), place.cast("string"))).cast("int"))
    return df.repartitionById(bins, checked.cast("int"))
