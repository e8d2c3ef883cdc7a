"""One reading of file names for Spark and for workers that open files themselves."""

from __future__ import annotations

import re

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

_S3 = re.compile(r"^s3[an]?://")


def for_spark(spark: SparkSession, place: str) -> str:
    """``s3://`` and ``s3n://`` as ``s3a://``, which Hadoop serves, unless the session names a
    file system for them; other names as they are."""
    scheme = place.split("://", 1)[0]
    if scheme in ("s3", "s3n") and not spark.sparkContext._jsc.hadoopConfiguration().get(f"fs.{scheme}.impl"):
        return _S3.sub("s3a://", place)
    return place


def qualified(spark: SparkSession, place: str) -> str:
    """The full name, with scheme and host: a name without a scheme lies on Hadoop's default file
    system, not on the disk of whichever machine opens it."""
    if _S3.match(place):  # needs no file system to be complete
        return for_spark(spark, place)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def opened(place: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a full name, for a worker. S3 takes the worker's credentials."""
    if "://" not in place and not place.startswith("file:"):
        raise ValueError(f"{place} isn't a full name")
    place = re.sub(r"^file:/+", "file:///", place)
    return pafs.FileSystem.from_uri(_S3.sub("s3://", place))
