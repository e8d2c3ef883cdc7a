"""Session defaults, the shared working folder and the intermediate results in it."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings for a session that this library starts itself; a given session is left as it is.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}
#: A side of a join is broadcast up to so many rows and bytes; both are counted first.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20

_open_folders: list[str] = []


def get_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (tests, local runs) a folder of this machine is made
    and set as the checkpoint folder; it is removed like the intermediates in it.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        place = spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="millrace-")
        _delete_on_exit(spark, place)
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy a row: a plain scan of fewer partitions than cores is spread over
    all of them. A larger one is left as it is, without a shuffle, and so is a plan with
    shuffles of its own, which adaptive execution sizes; counting runs no job."""
    plan = df._jdf.queryExecution()
    if plan.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def _path(spark: SparkSession, place: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_folder(spark: SparkSession, place: str) -> None:
    """Delete a folder on whatever file system it lies."""
    path, system = _path(spark, place)
    system.delete(path, True)


def folder_bytes(spark: SparkSession, place: str) -> int:
    path, system = _path(spark, place)
    return system.getContentSummary(path).getLength()


def _delete_on_exit(spark: SparkSession, place: str) -> None:
    """The JVM's file system deletes the folder when the driver ends, also after the session was stopped."""
    path, system = _path(spark, place)
    system.deleteOnExit(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh place in the shared folder, not made yet. It goes at the end of the
    enclosing ``intermediates`` block, or when the driver ends."""
    folder = f"{shared_dir(spark)}/millrace-{label}-{uuid.uuid4().hex}"
    path, system = _path(spark, folder)
    system.mkdirs(path)
    system.deleteOnExit(path)
    _open_folders.append(folder)
    return f"{folder}/data"


@contextlib.contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Drops what was written inside when the block ends. A result that reads intermediates
    must be used inside the block:

        with intermediates(spark):
            shared_pairs(find_repeats(docs)).write.parquet(place)
    """
    before = len(_open_folders)
    try:
        yield
    finally:
        mine = _open_folders[before:]
        del _open_folders[before:]
        for place in mine:
            drop_folder(spark, place)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    Lineage ends at files in the shared folder, so a lost executor costs no more
    than its running tasks.
    """
    place = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(place)
    out = df.sparkSession.read.schema(df.schema).parquet(place)
    out._millrace_folder = place.rsplit("/", 1)[0]
    return out


def release(*frames: DataFrame) -> None:
    """Drop the folders of frames that ``written`` gave and nothing reads any more."""
    for df in frames:
        if df._millrace_folder in _open_folders:
            _open_folders.remove(df._millrace_folder)
            drop_folder(df.sparkSession, df._millrace_folder)


def if_small(df: DataFrame, *sized: Column, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame | None:
    """A written frame marked for broadcast if it has at most ``rows`` rows and ``size`` bytes in
    all (of the text columns ``sized``, and 16 for each row), else None: join it by shuffle."""
    text = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in sized), F.lit(16))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(text), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else None
