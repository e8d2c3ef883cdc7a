"""The map/reduce-shaped surface: jobs and chained jobs as one DataFrame plan.

A mapper or a reducer is either *declarative*, a function of DataFrames (or Columns) that
Catalyst sees through, or *callable*, Python code over single records, run over Arrow
batches. Between the stages of a pipeline nothing is written.
"""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import n_fields
from millrace.operators.shuffle import custom_partition
from millrace.plans.conf import EngineConf, byte_ranges, next_fit, reducer_count
from millrace.session import folder_bytes, intermediates
from millrace.sources.sinks import write_key_value
from millrace.sources.text import existing, key_value, text_lines

Pairs = Iterable[tuple[str, str]]
KEY_VALUE = "key STRING, value STRING"
_BATCH = 10_000


def map_pairs(df: DataFrame, mapper: Callable[[str, str], Pairs]) -> DataFrame:
    """Call a Python mapper once a record; it yields any number of pairs. Nulls arrive as
    empty text. One mapper object serves a whole partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[str] = []
        values: list[str] = []
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for out_key, out_value in mapper(k or "", v or ""):
                    keys.append(str(out_key))
                    values.append(str(out_value))
                if len(keys) >= _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["key", "value"])
                    keys, values = [], []
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["key", "value"])

    return df.select(F.col("key").cast("string"), F.col("value").cast("string")).mapInArrow(work, KEY_VALUE)


def _frames(pairs: Pairs) -> Iterator[pd.DataFrame]:
    left = iter(pairs)
    while held := list(islice(left, _BATCH)):
        yield pd.DataFrame({"key": [str(k) for k, _ in held], "value": [str(v) for _, v in held]}, dtype=object)


def reduce_pairs(df: DataFrame, reducer: Callable[[str, Iterator[str]], Pairs]) -> DataFrame:
    """Call a Python reducer once a key with an iterator over its values, which come in
    batches in any order; it may stop early. What it yields goes on in batches, so neither
    a key's values nor its output are held. For counts, sums and the like use a
    declarative reducer, which combines before the shuffle."""

    def work(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(reducer(key[0], (v for f in frames for v in f["value"])))
        for _ in frames:  # what an early stop left over
            pass

    work.__annotations__ = {"key": tuple, "frames": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return df.groupBy("key").applyInPandas(work, KEY_VALUE)


@dataclass(frozen=True)
class Job:
    """``mapper``: DataFrame -> DataFrame(key, value), or a callable marked with ``udf=True``.
    ``reducer``: the same, or None to pass pairs through (no shuffle then).
    ``partitioner``: (key Column, bins) -> Column with the partition of a key."""

    mapper: Callable
    reducer: Callable | None = None
    partitioner: Callable[[Column, int], Column] | None = None
    bins: int = 1
    udf: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        pairs = map_pairs(df, self.mapper) if self.udf else self.mapper(df)
        if self.partitioner is not None:
            pairs = custom_partition(pairs, self.bins, self.partitioner(F.col("key"), self.bins))
        if self.reducer is None:
            return pairs
        return reduce_pairs(pairs, self.reducer) if self.udf else self.reducer(pairs)


@dataclass(frozen=True)
class RunReport:
    """What a run read, left out and wrote. ``dropped`` are lines whose number of fields isn't one the
    pipeline takes."""

    place: str
    lines_read: int
    bytes_read: int
    dropped: int
    rows_written: int
    bytes_written: int
    seconds: float


@dataclass
class Pipeline:
    """Jobs in a row over text inputs; one plan. ``arity`` names the numbers of fields that its lines
    may have, for counting those left out; empty: any."""

    jobs: list[Job]
    conf: EngineConf = field(default_factory=EngineConf)
    arity: tuple[int, ...] = ()

    def _lines(self, spark: SparkSession, inputs: tuple[str, ...]) -> DataFrame:
        return text_lines(self.conf.session(spark), *(inputs or self.conf.inputs))

    def plan(self, spark: SparkSession, *inputs: str) -> DataFrame:
        """The result as a frame of a session of its own, in which the settings hold."""
        return self.over(key_value(self._lines(spark, inputs)))

    def over(self, df: DataFrame) -> DataFrame:
        for job in self.jobs:
            df = job.apply(df)
        return df

    def describe(self, spark: SparkSession, *inputs: str) -> dict[str, int]:
        """Files that hold something, bytes, and the splits, map bins and reducers that the settings ask for. Spark plans
        its own partitions from the same sizes."""
        sizes = self._lines_sizes(spark, inputs)
        splits = [hi - lo + 1 for n in sizes for lo, hi in byte_ranges(n, self.conf.split_size)]
        return {"files": len(sizes), "bytes": sum(sizes), "splits": len(splits), "map_bins": len(next_fit(splits, self.conf.map_bin_size)), "reducers": reducer_count(sum(sizes), self.conf.reduce_bin_size)}

    def _lines_sizes(self, spark: SparkSession, inputs: tuple[str, ...]) -> list[int]:
        found = existing(spark, inputs or self.conf.inputs)
        if not found:
            return []
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(found)
        return [r.length for r in files.select("path", "length").orderBy("path").toLocalIterator()]

    def run(self, spark: SparkSession, *inputs: str) -> RunReport:
        """Write ``key\\tvalue`` lines under the working location. Failures raise: there is no partial
        result. Counters are observed while the one plan runs."""
        began = time.time()
        read, wrote = Observation(), Observation()
        value = F.col("value")
        dropped = F.count(F.when(~n_fields(value).isin(list(self.arity)) if self.arity else F.lit(False), 1))
        # a line's own end counts
        counts = (F.count("*").alias("lines"), F.coalesce(F.sum(F.octet_length(value) + 1), F.lit(0)).alias("bytes"), dropped.alias("dropped"))
        # a plan over nothing is folded away with its observations
        some = bool(existing(spark, inputs or self.conf.inputs))
        with intermediates(spark) if self.conf.cleanup else contextlib.nullcontext():
            lines = self._lines(spark, inputs)
            out = self.over(key_value(lines.observe(read, *counts) if some else lines))
            if some:
                out = out.observe(wrote, F.count("*").alias("rows"))
            place = f"{self.conf.working_location.rstrip('/')}/output"
            if self.conf.verbose:
                out.explain("formatted")
            write_key_value(out, place, F.col("key"), [F.col(c) for c in out.columns if c != "key"])
        seen = read.get if some else {"lines": 0, "bytes": 0, "dropped": 0}
        rows = wrote.get["rows"] if some else spark.read.text(place).count()
        return RunReport(place, seen["lines"], seen["bytes"], seen["dropped"], rows, folder_bytes(spark, place), time.time() - began)
