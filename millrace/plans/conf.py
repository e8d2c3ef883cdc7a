"""Settings of a pipeline and the Spark settings they stand for."""

from __future__ import annotations

import dataclasses
import json
import os
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

MB = 1 << 20
ENV_PREFIX = "MILLRACE_"


@dataclasses.dataclass(frozen=True)
class EngineConf:
    """Sizes are bytes. Later sources win: defaults, file, environment, flags, code.

    ``max_concurrency``, where set, bounds how many tasks a shuffle feeds; ``cleanup`` drops a
    run's intermediates at its end; ``verbose`` prints the plan and the counters."""

    # default sizes that results of plans are compared by. Fixed values.
    split_size: int = 100 * MB
    map_bin_size: int = 512 * MB
    reduce_bin_size: int = 512 * MB
    max_concurrency: int | None = None
    working_location: str = "."
    cleanup: bool = True
    verbose: bool = False
    inputs: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name in ("split_size", "map_bin_size", "reduce_bin_size", "max_concurrency"):
            if getattr(self, name) is not None and getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        # a split is never larger than the map input it goes into
        if self.split_size > self.map_bin_size:
            object.__setattr__(self, "split_size", self.map_bin_size)

    def with_(self, **changes: Any) -> EngineConf:
        return dataclasses.replace(self, **{k: v for k, v in changes.items() if v is not None})

    @classmethod
    def load(cls, file: str | None = None, **code: Any) -> EngineConf:
        """``file`` (JSON; by default ``.millrace.json`` here or in the home folder), then
        ``MILLRACE_*`` of the environment, then ``code``."""
        values: dict[str, Any] = {}
        for place in [file] if file else [".millrace.json", str(Path.home() / ".millrace.json")]:
            if Path(place).is_file():
                values |= json.loads(Path(place).read_text())
                break
        kinds = {f.name: f.default for f in dataclasses.fields(cls)}
        for name, default in kinds.items():
            if (text := os.environ.get(ENV_PREFIX + name.upper())) is not None:
                if isinstance(default, bool):
                    values[name] = text.strip().lower() in ("1", "true", "yes")
                else:
                    values[name] = int(text) if isinstance(default, int) or default is None else tuple(text.split(",")) if isinstance(default, tuple) else text
        if unknown := set(values) - set(kinds):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        if "inputs" in values:
            values["inputs"] = tuple(values["inputs"])
        return cls(**values).with_(**code)

    def spark_settings(self) -> dict[str, str]:
        return {
            "spark.sql.files.maxPartitionBytes": str(self.split_size),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(self.reduce_bin_size),
        }

    def session(self, spark: SparkSession) -> SparkSession:
        """A session of its own with these settings and the given one's others; the given one
        is left as it is."""
        own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
        for key, value in self.spark_settings().items():
            own.conf.set(key, value)
        if self.max_concurrency is not None:
            own.conf.set("spark.sql.shuffle.partitions", str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), self.max_concurrency)))
        return own


def reducer_count(total_bytes: int, reduce_bin_size: int) -> int:
    """How many reducers whole bins of input ask for, with a quarter more; at least one.
    Adaptive execution chooses by itself; this is for fixed placements and reports."""
    return max(1, int(total_bytes // max(1, reduce_bin_size) * 1.25))


def byte_ranges(size: int, most: int) -> list[tuple[int, int]]:
    """Inclusive byte ranges of at most ``most`` bytes that cover a file. Spark plans its own
    splits; this describes them for reports."""
    return [(at, min(at + most, size) - 1) for at in range(0, size, most)]


def next_fit(sizes: list[int], most: int) -> list[list[int]]:
    """Consecutive sizes packed into bins of at most ``most``; a larger one has its own bin."""
    bins: list[list[int]] = []
    room = -1
    for size in sizes:
        if size > room:
            bins.append([])
            room = most
        bins[-1].append(size)
        room -= size
    return bins
