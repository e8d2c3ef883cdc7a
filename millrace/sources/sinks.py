"""Text output of keyed results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_key_value(df: DataFrame, place: str, key: Column, values: Sequence[Column], mode: str = "overwrite") -> None:
    """Lines ``key\\tvalue...``. Nulls become empty fields so that columns stay in place; tabs
    and line breaks inside are not escaped (use Parquet between stages)."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (key, *values)]
    df.select(F.concat_ws("\t", *parts).alias("value")).write.mode(mode).text(place)
