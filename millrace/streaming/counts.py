"""The keyed counts over a stream: windows over event time with a bound on lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, key, n) per tumbling window. On a stream, rows later than ``late`` are dropped
    and the state of closed windows goes; on a batch all rows count. Null times are dropped."""
    timed = events.where(F.col(time).isNotNull()).withColumn("__at", F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__at", late)
    return timed.groupBy(F.window("__at", width).alias("__w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.col("__w.start").alias("start"), "key", "n")
