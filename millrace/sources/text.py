"""Text inputs: lines, key/value lines, delimited records, several inputs at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import fields, n_fields
from millrace.operators.malformed import chomp
from millrace.sources.places import for_spark


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths and globs that match something, on whatever file system they lie, as Spark reads them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in (for_spark(spark, p) for p in paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        match = path.getFileSystem(conf).globStatus(path)
        if match is not None and len(match):
            found.append(p)
    return found


def text_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(value): one row a line of all files, folders (also nested) and globs. Lines end at
    ``\\n``; one trailing ``\\r`` is dropped; empty lines are rows; there is no limit on
    length. Inputs that don't exist count as empty. Files whose names start with ``_`` or
    ``.`` are skipped, as everywhere in Spark."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "value STRING")
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(found)
    return lines.select(chomp(F.col("value")).alias("value"))


def key_value(lines: DataFrame, value: str = "value") -> DataFrame:
    """(key, value): a line of exactly two tab-separated fields is a pair; any other line is a
    value under the empty key. A null line gives an empty key and a null value."""
    # most lines of most inputs have no tab and needn't be split
    parts = F.when(F.col(value).contains("\t"), F.split(F.col(value), "\t", -1))
    pair = F.coalesce(F.size(parts) == 2, F.lit(False))
    return lines.select(F.when(pair, parts[0]).otherwise("").alias("key"), F.when(pair, parts[1]).otherwise(F.col(value)).alias("value"))


def delimited(lines: DataFrame, names: Sequence[str], value: str = "value", separator: str = ",") -> DataFrame:
    """The text fields of lines with as many fields as names; other lines are left out
    (``arity_errors`` counts them). No quoting."""
    parts = fields(F.col(value), separator)
    return lines.where(n_fields(F.col(value), separator) == len(names)).select(*[parts[i].alias(n) for i, n in enumerate(names)])


def arity_errors(lines: DataFrame, arity: Sequence[int], value: str = "value", separator: str = ",") -> DataFrame:
    """(n_fields, lines): how many lines have a number of fields outside ``arity``."""
    n = F.coalesce(n_fields(F.col(value), separator), F.lit(0))
    return lines.select(n.alias("n_fields")).where(~F.col("n_fields").isin(list(arity))).groupBy("n_fields").agg(F.count("*").alias("lines"))


def union_inputs(*inputs: tuple[str, DataFrame]) -> DataFrame:
    """All rows of several inputs, each tagged with its name in ``source``; columns that an
    input lacks are null."""
    first, *rest = (df.select(F.lit(name).alias("source"), *[c for c in df.columns if c != "source"]) for name, df in inputs)
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
