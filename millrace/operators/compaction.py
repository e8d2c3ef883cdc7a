"""Consolidation of masses of small files.

``small_files`` picks from a listing what to consolidate, ``with_footers`` reads what their
footers say, ``plan_outputs`` spreads the files of one area and one schema over as many
outputs as the target size asks for, and ``consolidate`` joins them by copying their encoded
column blocks and rewriting footers (``sources.footer``): pages are never decoded. Blocks
without dictionaries of many files become well-sized row groups. Each output is written by
one task under a temporary name and then renamed, so a repeated task changes nothing.
Schema, block counts and row totals are validated per output, and a mismatch raises.
``compact`` does all of it, into a folder of the caller's, with the list of files replaced.

Defined results: a null name is no file; of several listings of one file the latest
holds (a null time is the oldest, then the greatest id); null, zero and too large
sizes are not small; an empty listing consolidates nothing; an empty file's schema is kept.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby, islice
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import scratch, spread, written
from millrace.sources import footer
from millrace.sources.places import for_spark, opened, qualified

MIB = 1 << 20
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def shortest_spelling(name: Column) -> Column:
    """A path without empty and ``.`` segments after its scheme and with ``..`` resolved;
    ``..`` at the top is dropped."""
    scheme = F.regexp_extract(name, _SCHEME, 0)
    rest = F.substring(name, F.length(scheme) + 1, F.length(name))
    parts = F.filter(F.split(rest, "/", -1), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)),
    )
    lead = F.when((scheme == "") & rest.startswith("/"), F.lit("/")).otherwise(scheme)
    # most names are short already
    return F.when(rest.contains("//") | rest.contains("/.") | rest.rlike(r"^\.|^/|/\z"), F.concat(lead, F.array_join(kept, "/"))).otherwise(name)


def folder_of(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)^(.*)/[^/]*\z", 1)


def latest_listing(files: DataFrame, name: str = "name", size: str = "size", at: str = "listed_at", tie: str = "listing_id") -> DataFrame:
    """(name, size) of each file by its shortest spelling."""
    rows = files.where(F.col(name).isNotNull()).select(shortest_spelling(F.col(name)).alias("name"), F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(size).alias("size")).alias("listing"))
    return rows.groupBy("name").agg(F.max("listing").alias("listing")).select("name", F.col("listing.size").alias("size"))


def small_files(listing: DataFrame, least: int = 1, below: int = MIB) -> DataFrame:
    """(name, folder, size): files of ``least`` to ``below`` - 1 bytes that aren't hidden or
    markers and whose folder holds another such file. ``listing`` has one row a file."""
    folder = folder_of(F.col("name"))
    last = F.substring_index("name", "/", -1)
    small = listing.where((F.col("size") >= least) & (F.col("size") < below) & ~last.startswith(".") & ~last.startswith("_")).select("name", folder.alias("folder"), "size")
    many = small.groupBy("folder").count().where("count > 1").select("folder")
    return small.join(many, "folder", "left_semi").select("name", "folder", "size")


def _ahead(work: Callable[[str], Any], paths: Sequence[str], most: int = 16) -> Iterator:
    """Results in order, with ``most`` calls under way: small files over a network cost mostly
    waiting. On a local disk threads only cost time."""
    if all(p.startswith("file:") for p in paths):
        yield from map(work, paths)
        return
    with ThreadPoolExecutor(most) as pool:
        left = iter(paths)
        running = deque(pool.submit(work, x) for x in islice(left, most))
        while running:
            done = running.popleft().result()
            running.extend(pool.submit(work, x) for x in islice(left, 1))
            yield done


_FOOTER = pa.schema([("name", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("area", pa.string()), ("blocks", pa.int64()), ("rows", pa.int64()), ("schema", pa.string()), ("plain", pa.bool_())])
_FOOTER_SQL = "name STRING, path STRING, size BIGINT, area STRING, blocks BIGINT, rows BIGINT, schema STRING, plain BOOLEAN"


def read_tail(path: str, guess: int = 1 << 16) -> bytes:
    """The end of a Parquet file with its whole footer."""
    place, at = opened(path)
    with place.open_input_file(at) as f:
        size = f.size()
        f.seek(max(0, size - guess))
        tail = f.read()
        need = int.from_bytes(tail[-8:-4], "little") + 8
        if len(tail) < min(need, size):
            f.seek(size - need)
            tail = f.read()
    return tail


def with_footers(files: DataFrame) -> DataFrame:
    """(name, path, size, area, blocks, rows, schema, plain) of Parquet files (name, path, size, area):
    row groups and rows, a fingerprint of the schema, and whether all blocks do without dictionaries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.to_pydict()
            blocks, rows, schemas, plain = [], [], [], []
            for tail in _ahead(read_tail, columns["path"]):
                fields = footer.read_footer(tail)
                groups = footer.row_groups(fields)
                blocks.append(len(groups))
                rows.append(fields[3][1])
                schemas.append(xxhash.xxh64_hexdigest(footer.packed(*fields[2])))
                plain.append(all(map(footer.is_plain, groups)))
            yield pa.RecordBatch.from_pydict(columns | {"blocks": blocks, "rows": rows, "schema": schemas, "plain": plain}, schema=_FOOTER)

    return spread(files.select("name", "path", "size", "area")).mapInArrow(work, _FOOTER_SQL)


def plan_outputs(files: DataFrame, target: int = 128 * MIB, most_blocks: int = 8192) -> DataFrame:
    """The files of ``with_footers`` with ``output``: which output of its area and schema takes a
    file. The number of outputs follows the bytes and, for blocks that keep their dictionaries
    and so stay row groups of their own, the blocks (a footer names each); hashing spreads
    the files."""
    files = files.withColumn("area", F.coalesce("area", F.lit("")))
    sums = files.groupBy("area", "schema").agg(F.sum("size").alias("bytes"), F.sum(F.when(F.col("plain"), 0).otherwise(F.col("blocks"))).alias("all_blocks"))
    n = F.greatest(F.ceil(F.col("bytes") / target), F.ceil(F.col("all_blocks") * 1.1 / most_blocks), F.lit(1))
    outputs = sums.select("area", "schema", n.cast("int").alias("n"))
    return files.join(outputs, ["area", "schema"]).withColumn("output", F.expr("pmod(xxhash64(path), n)").cast("int")).drop("n")


def _publish(place: pafs.FileSystem, temporary: str, final: str) -> None:
    """Rename over what an earlier attempt of the same task may have left."""
    try:
        place.move(temporary, final)
    except OSError:  # some file systems don't rename onto a file
        place.delete_file(final)
        place.move(temporary, final)


def _read(path: str) -> bytes:
    place, at = opened(path)
    with place.open_input_stream(at) as f:
        return f.read()


def consolidate(planned: DataFrame, out_dir: str) -> DataFrame:
    """Write the outputs of ``plan_outputs`` under ``out_dir``, a folder for each area and schema;
    (name, path, area, out_file, out_bytes, out_blocks, out_rows, rows), one row per file
    replaced. A task holds one row group and a few small files at a time."""
    out_dir = qualified(planned.sparkSession, out_dir)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            yield one(pd.concat(parts, ignore_index=True))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        area, schema, output = pdf["area"].iloc[0], pdf["schema"].iloc[0], int(pdf["output"].iloc[0])
        name = f"{out_dir}/{hash_text(area):016x}-{schema}/part-{output:05d}.parquet"
        place, path = opened(name)
        place.create_dir(os.path.dirname(path), recursive=True)
        temporary = f"{os.path.dirname(path)}/_tmp-{os.urandom(8).hex()}"
        pdf = pdf.sort_values("path", kind="stable")
        rows = []
        with place.open_output_stream(temporary) as sink:
            joined = footer.Joined(sink)
            for data in _ahead(_read, pdf["path"].tolist()):
                rows.append(joined.add(data)[0])
            joined.close()
        if xxhash.xxh64_hexdigest(joined.schema) != schema:
            raise ValueError(f"{name}: the schema isn't the planned one")
        with place.open_input_file(temporary) as f:
            meta = pq.read_metadata(f)
            size = f.size()
        if meta.num_rows != sum(rows) or meta.num_rows != pdf["rows"].sum() or joined.blocks != pdf["blocks"].sum() or meta.num_row_groups != len(joined.groups):
            raise ValueError(f"{name}: {meta.num_rows} rows of {joined.blocks} blocks, {pdf['rows'].sum()} of {pdf['blocks'].sum()} were to be copied")
        _publish(place, temporary, path)
        return pd.DataFrame({"name": pdf["name"], "path": pdf["path"], "area": area, "out_file": name, "out_bytes": size, "out_blocks": meta.num_row_groups, "out_rows": meta.num_rows, "rows": rows})

    # rows of the plan are few bytes and much work, so every output has a partition of its own; the
    # list of outputs is short (one a target size)
    key = ["area", "schema", "output"]
    outputs = written(planned.select(*key).distinct().withColumn("number", F.row_number().over(Window.orderBy(*key)) - 1), "outputs")
    n = max(1, outputs.count())
    placed = planned.join(outputs, key).repartitionById(n, F.col("number"))
    return placed.mapInPandas(work, "name STRING, path STRING, area STRING, out_file STRING, out_bytes BIGINT, out_blocks BIGINT, out_rows BIGINT, rows BIGINT")


def listed(spark: SparkSession, *folders: str, pattern: str = "*.parquet") -> DataFrame:
    """(name, size, listed_at, listing_id) of the files below folders or globs, like a listing table.
    The driver lists; for masses of files give ``compact`` a listing table instead."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load([for_spark(spark, f) for f in folders])
    return files.select(F.col("path").alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("listed_at"), F.lit(0).cast("bigint").alias("listing_id"))


def compact(listing: DataFrame, out_dir: str, target: int = 128 * MIB, below: int = 16 * MIB) -> DataFrame:
    """Consolidate the small Parquet files of a listing (name, size, listed_at, listing_id), whose
    names are full, into ``out_dir``; the list of files replaced, which is kept in
    ``out_dir/_replaced``. Nothing is deleted: that is the caller's, once readers have moved."""
    spark = listing.sparkSession
    small = small_files(latest_listing(listing), below=below).select("name", F.col("name").alias("path"), "size", F.col("folder").alias("area"))
    done = consolidate(plan_outputs(written(with_footers(small), "footers"), target), out_dir)
    manifest = f"{qualified(spark, out_dir)}/_replaced"
    done.write.mode("overwrite").parquet(manifest)
    return spark.read.parquet(manifest)


def hash_text(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def land(lines: DataFrame, out_dir: str, name: str = "file_name", number: str = "line_no", piece_rows: int = 50_000) -> DataFrame:
    """Write each landing file's lines as a small Parquet file; (name, path, size). A file of more
    than ``piece_rows`` line numbers lands in pieces, each of which is one task's at most;
    file name and line number must not be null."""
    out_dir = qualified(lines.sparkSession, out_dir)
    order = F.floor(F.col(number) / piece_rows)
    sorted_lines = lines.withColumn("__piece", order).repartition(F.col(name), F.col("__piece")).sortWithinPartitions(name, "__piece", number)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, int]] = []
        held: list[pa.RecordBatch] = []
        current: tuple[str, int] | None = None
        made: set[str] = set()

        def flush() -> None:
            if current is None:
                return
            digest = hash_text(f"{current[0]}\0{current[1]}")
            uri = f"{out_dir}/{digest % 1024:03x}/{digest:016x}.parquet"
            place, path = opened(uri)
            if (parent := os.path.dirname(path)) not in made:
                place.create_dir(parent, recursive=True)
                made.add(parent)
            table = pa.Table.from_batches(held).drop_columns(["__piece"]).replace_schema_metadata(None).combine_chunks()
            temporary = f"{parent}/_tmp-{os.urandom(8).hex()}"
            with place.open_output_stream(temporary) as sink:
                pq.write_table(table, sink, compression="zstd", use_dictionary=False, write_statistics=False, row_group_size=max(1, table.num_rows), store_schema=False)
            size = place.get_file_info(temporary).size
            _publish(place, temporary, path)
            out.append((current[0], uri, size))

        for b in batches:
            names, pieces = b.column(name).to_pylist(), b.column("__piece").to_pylist()
            at = 0
            for key, run in groupby(zip(names, pieces)):
                n = sum(1 for _ in run)
                if key != current:
                    flush()
                    current, held = key, []
                held.append(b.slice(at, n))
                at += n
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(_LANDED, x)) for x in out], schema=_LANDED_ARROW)
                out.clear()
        flush()
        yield pa.RecordBatch.from_pylist([dict(zip(_LANDED, x)) for x in out], schema=_LANDED_ARROW)

    return sorted_lines.mapInArrow(work, "name STRING, path STRING, size BIGINT")


_LANDED_ARROW = pa.schema([("name", pa.string()), ("path", pa.string()), ("size", pa.int64())])
_LANDED = _LANDED_ARROW.names


def distinct_lines(lines: DataFrame, columns: Sequence[str], name: str = "file_name", number: str = "line_no", at: str = "loaded_at", tie: str = "line_id", most: int = 4_000_000) -> DataFrame:
    """Each (file, line number) once, with ``columns``: the latest load, then the greatest id.
    Lines without a file or a number can't be placed in a landing file and are left out.

    Counts of hashes tell which lines were loaded more than once; only those are shuffled
    to be compared, combined before. Up to ``most`` such hashes are broadcast; if more lines
    were loaded again, all are compared."""
    rows = lines.where(F.col(name).isNotNull() & F.col(number).isNotNull())
    row = F.struct(F.col(at).alias("a"), F.col(tie).alias("t"), F.struct(*columns).alias("row"))

    def latest(df: DataFrame) -> DataFrame:
        return df.groupBy(name, number).agg(F.max(row).alias("m")).select(name, number, "m.row.*")

    mark = F.xxhash64(name, number)
    again = written(rows.groupBy(mark.alias("__mark")).agg(F.count("*").alias("n")).where("n > 1").select("__mark"), "loaded_again")
    if again.count() > most:
        return latest(rows)
    sent = F.broadcast(again)
    same = mark == F.col("__mark")
    return rows.join(sent, same, "left_anti").select(name, number, *columns).unionByName(latest(rows.join(sent, same, "left_semi")))


def consolidate_lines(lines: DataFrame, target: int = 128 * MIB, columns: Sequence[str] = ("recordtype", "key", "value")) -> DataFrame:
    """Land the distinct lines as small files and consolidate those by block copying; the
    result of ``consolidate``, written. The area of a landing file is the folder above its own.
    The files lie in the shared folder, like every intermediate."""
    spark = lines.sparkSession
    base = scratch(spark, "landing")
    landed = written(land(distinct_lines(lines, columns), f"{base}/small"), "listing").withColumn("area", folder_of(folder_of(F.col("name"))))
    return written(consolidate(plan_outputs(written(with_footers(landed), "footers"), target), f"{base}/large"), "replaced")
