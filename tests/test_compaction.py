import io
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.operators import compaction as c
from millrace.sources import places
from millrace.sources.footer import Joined, packed_fields, read_footer

LISTING = "listing_id BIGINT, name STRING, size BIGINT, listed_at TIMESTAMP_NTZ, folder STRING, listing STRING"
LINES = "line_id BIGINT, file_name STRING, line_no BIGINT, recordtype STRING, key STRING, value STRING, loaded_at TIMESTAMP_NTZ, a STRING, row STRING, m STRING"


@pytest.mark.parametrize(
    "name, short",
    [
        ("s3://b/a/c", "s3://b/a/c"), ("s3://b//a/./c", "s3://b/a/c"), ("s3://b/x/../a/c", "s3://b/a/c"), ("s3://b/x/y/../../a", "s3://b/a"), ("s3://b/.hid/_x", "s3://b/.hid/_x"),
        ("s3://b/a..b/..c/d", "s3://b/a..b/..c/d"), ("s3:///b/a", "s3://b/a"), ("s3://b/a/", "s3://b/a"), ("/x/./y", "/x/y"), ("s3://b/a/..", "s3://b"), ("", ""), ("s3://../a", "s3://a"), ("s3://b/日/./本", "s3://b/日/本"),
    ],
)
def test_spelling(spark, name, short):
    assert spark.createDataFrame([(name,)], "n STRING").select(c.shortest_spelling(F.col("n"))).first()[0] == short


def test_small_files(spark):
    t = lambda d: datetime(2000, 1, d)
    rows = [
        (1, "s3://b/d/1", 10, t(1)), (2, "s3://b/d/./1", 2 << 20, t(2)), (3, "s3://b/d/2", 1048575, t(1)), (4, "s3://b/d/3", 1, None), (5, "s3://b/d/3", 0, None),
        (6, "s3://b/d/_SUCCESS", 5, t(1)), (7, "s3://b/d/.x", 5, t(1)), (8, "s3://b/d/4", 1048576, t(1)), (9, "s3://b/e/1", 5, t(1)), (10, "s3://b/e/2", None, t(1)), (11, None, 5, t(1)),
        (12, "s3://b/f/1", 5, t(1)), (13, "s3://b/f/2", 5, t(1)), (14, "s3://b/f//2", 5, t(1)), (15, "s3://b/f/3", None, t(2)), (16, "s3://b/f/3", 9, t(1)), (17, "s3://b/d/5", 7, t(3)),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], LISTING)
    # /1 grew, /3 is empty by the later id, e has one small file
    assert sorted(r.name for r in c.small_files(c.latest_listing(df)).collect()) == ["s3://b/d/2", "s3://b/d/5", "s3://b/f/1", "s3://b/f/2"]
    assert c.small_files(c.latest_listing(df.limit(0))).collect() == []


def as_file(table, **kw):
    out = io.BytesIO()
    pq.write_table(table, out, **kw)
    return out.getvalue()


def test_footer_round_trip():
    data = as_file(pa.table({"a": [1, None, 3], "b": ["x", "y", None], "c": [[1, 2], None, []], "d": [1.5, 2.5, None]}), row_group_size=2, write_page_index=True)
    footer = read_footer(data)
    n = int.from_bytes(data[-8:-4], "little")
    assert packed_fields(footer) == data[-8 - n : -8]


@pytest.mark.parametrize("kw", [{}, {"compression": "none", "use_dictionary": False}, {"compression": "zstd", "write_page_index": True, "data_page_version": "2.0"}])
def test_joined_blocks_read_back(kw):
    tables = [pa.table({"a": list(range(i, i + n)), "s": [f"v{k % 3}" * 5 for k in range(n)], "l": [[k, None] for k in range(n)]}) for i, n in ((0, 5), (100, 1), (200, 3000), (7, 0))]
    tables = [t.cast(tables[0].schema) for t in tables]
    sink = io.BytesIO()
    joined = Joined(sink)
    for t in tables:
        joined.add(as_file(t, row_group_size=1000, **kw))
    assert joined.close() == len(sink.getvalue())
    assert pq.read_table(io.BytesIO(sink.getvalue())).equals(pa.concat_tables(tables))


def test_joined_refuses():
    joined = Joined(io.BytesIO())
    joined.add(as_file(pa.table({"a": [1]})))
    with pytest.raises(ValueError, match="schemas"):
        joined.add(as_file(pa.table({"b": [1]})))
    with pytest.raises(ValueError, match="Parquet"):
        joined.add(b"nothing of the kind")
    with pytest.raises(ValueError, match="no file"):
        Joined(io.BytesIO()).close()


def lines(spark, rows):
    return spark.createDataFrame([(*r, "p", "q", "r") for r in rows], LINES)


def test_lines_once_each(spark):
    t = lambda d: datetime(2000, 1, d)
    rows = [(i, f"s3://b/land/{'xy'[i % 2]}/p{i % 5}", i // 5, "0", None if i % 7 == 0 else f"k{i}", "v" * (i % 9) if i % 11 else None, t(1)) for i in range(120)]
    rows += [(1000 + i, *r[1:5], "late", t(2)) for i, r in enumerate(rows[:30])] + [(2000, "s3://b/land/x/big", n, "1", "k", "日" * 50_000, None) for n in range(3)]
    rows += [(3000, None, 1, "0", "k", "v", t(1)), (3001, "s3://b/land/x/p1", None, "0", "k", "v", t(1))]
    done = c.consolidate_lines(lines(spark, rows), target=3_000).collect()
    out = sorted({r.out_file for r in done})
    want = {}
    for r in sorted(rows, key=lambda r: (r[6] or t(1), r[0])):
        if r[1] and r[2] is not None:
            want[r[1], r[2]] = r[3:6]
    got = [((r.file_name, r.line_no), (r.recordtype, r.key, r.value)) for r in spark.read.parquet(*out).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert 2 < len(out) < len(done) and sum(r.rows for r in done) == len(want)
    for r in done:
        assert r.out_rows == sum(x.rows for x in done if x.out_file == r.out_file) and r.out_blocks == 1


def test_long_files_land_in_pieces(spark):
    from millrace.session import scratch

    rows = lines(spark, [(i, "s3://b/l/f", i, "0", "k", str(i), None) for i in range(250)]).select("file_name", "line_no", "value")
    landed = c.with_footers(c.land(rows, scratch(spark, "pieces"), piece_rows=100).withColumn("area", F.lit("a"))).collect()
    assert sorted((r.rows, r.blocks, r.plain) for r in landed) == [(50, 1, True), (100, 1, True), (100, 1, True)] and len({r.schema for r in landed}) == 1


def test_nothing_to_do(spark):
    assert c.consolidate_lines(lines(spark, [])).collect() == []


def test_wrong_totals_raise(spark):
    from millrace.session import scratch

    base = scratch(spark, "wrong")
    landed = c.land(lines(spark, [(1, "s3://b/l/f", 1, "0", "k", "v", None)]).select("file_name", "line_no", "value"), base)
    read = c.with_footers(spark.createDataFrame(landed.collect(), landed.schema).withColumn("area", F.lit("s")))
    read = spark.createDataFrame(read.collect(), read.schema)
    for name, spoil, said in (("rows", F.col("rows") + 1, "were to be copied"), ("blocks", F.col("blocks") + 1, "were to be copied"), ("schema", F.lit("0" * 16), "planned")):
        with pytest.raises(Exception, match=said):
            c.consolidate(c.plan_outputs(read.withColumn(name, spoil)), base + "/large").collect()


def test_plain_blocks_of_many_files_become_one_row_group():
    tables = [pa.table({"a": pa.array([k, None, k + 1]), "s": [f"日{k}", "", None], "l": [[k], None, []]}, schema=pa.schema([("a", pa.int64()), ("s", pa.string()), ("l", pa.list_(pa.int64()))])) for k in range(200)]
    sink = io.BytesIO()
    joined = Joined(sink, group_bytes=10_000)
    for k, t in enumerate(tables):
        joined.add(as_file(t, use_dictionary=k == 100, compression="zstd", data_page_version="2.0" if k % 2 else "1.0"))
    joined.close()
    back = pq.ParquetFile(io.BytesIO(sink.getvalue()))
    assert joined.blocks == 200 and 3 < back.metadata.num_row_groups < 10 and back.read().equals(pa.concat_tables(tables))
    groups = [back.metadata.row_group(i) for i in range(back.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 600 and 1 in [g.num_rows // 3 for g in groups]
    assert all(g.column(0).total_compressed_size > 0 for g in groups)


def test_a_users_files_are_compacted_where_asked(spark, tmp_path):
    """Two folders, one with two schemas; the result and the list of files replaced stay."""
    want = []
    for n in range(12):
        for area in "xy":
            (tmp_path / "in" / area).mkdir(parents=True, exist_ok=True)
            columns = {"a": [n, None], "s": [f"{area}{n}", "z"]} if area == "x" or n % 2 else {"a": [n, None], "s": [f"{area}{n}", "z"], "extra": [1.0, None]}
            pq.write_table(pa.table(columns), tmp_path / "in" / area / f"p{n}.parquet")
            want += [(r.get("a"), r.get("s"), r.get("extra")) for r in pa.table(columns).to_pylist()]
    (tmp_path / "in" / "x" / "_SUCCESS").write_bytes(b"")
    done = c.compact(c.listed(spark, f"{tmp_path}/in"), f"{tmp_path}/out")
    assert done.count() == 24 and done.select("out_file").distinct().count() == 3
    got = []
    for r in done.select("out_file").distinct().collect():
        got += [(x.get("a"), x.get("s"), x.get("extra")) for x in pq.read_table(r.out_file.removeprefix("file://").removeprefix("file:")).to_pylist()]
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(want)
    assert spark.read.parquet(f"{tmp_path}/out/_replaced").count() == 24
    again = c.compact(c.listed(spark, f"{tmp_path}/in"), f"{tmp_path}/out")
    assert again.count() == 24 and order(x.s for x in spark.read.option("mergeSchema", "true").parquet(f"{tmp_path}/out/[0-9a-f]*").collect()) == order(w[1] for w in want)


def test_names_mean_the_same_to_spark_and_workers(spark, tmp_path):
    assert places.for_spark(spark, "s3://b/k") == places.for_spark(spark, "s3n://b/k") == places.qualified(spark, "s3://b/k") == "s3a://b/k"
    assert places.for_spark(spark, "/a") == "/a" and places.for_spark(spark, "hdfs://h/a") == "hdfs://h/a"
    (tmp_path / "f").write_text("x")
    for name in (f"{tmp_path}/f", f"file:{tmp_path}/f", f"file://{tmp_path}/f"):
        full = places.qualified(spark, name)
        system, path = places.opened(full)
        assert full.startswith("file:/") and system.get_file_info(path).size == 1
    system, path = places.opened("s3a://bucket/a/b?region=us-east-1")
    assert system.type_name == "s3" and path == "bucket/a/b"
    with pytest.raises(ValueError, match="full name"):
        places.opened("/a/b")


def test_duplicates_however_many(spark):
    t = lambda d: datetime(2000, 1, d)
    rows = [(i, "f", i % 3, "0", str(i), "v", None if i == 7 else t(1 + i % 5)) for i in range(60)] + [(99, "g", 0, "0", "only", "v", None)]
    for most in (10, 0):
        got = {(r.file_name, r.line_no): r.key for r in c.distinct_lines(lines(spark, rows), ["key"], most=most).collect()}
        want = {}
        for r in sorted(rows, key=lambda r: (r[6] or t(1).replace(year=1), r[0])):
            want[r[1], r[2]] = r[4]
        assert got == want
