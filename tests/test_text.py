import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.hashing import fnv1_bin, fnv1_values
from millrace.functions.text import fields, fixed6, n_fields, prefix, sanitized, strict_date, strict_float, strict_int, tokens, words
from millrace.operators import aggregates, filters, joins, shuffle
from millrace.sources.sinks import write_key_value
from millrace.sources.text import arity_errors, delimited, key_value, text_lines, union_inputs


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t STRING").select(make(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "line, pair",
    [
        ("foo\tbar", ("foo", "bar")), ("foo\tbar\tbaz", ("", "foo\tbar\tbaz")), ("foo bar baz", ("", "foo bar baz")), ("key without value\t", ("key without value", "")),
        ("\tvalue without key", ("", "value without key")), ("", ("", "")), (None, ("", None)), ("\t", ("", "")),
    ],
)
def test_key_value(spark, line, pair):
    assert tuple(key_value(spark.createDataFrame([(line,)], "value STRING")).first()) == pair


def test_lines(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "1.txt").write_bytes(b"x\r\n\nba\rre\n" + b"y" * 70_000)
    (tmp_path / "a" / "b" / "2.txt").write_bytes(b"nested\n")
    (tmp_path / "a" / "3.txt").write_bytes(b"")
    got = sorted(r.value for r in text_lines(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/nothing*").collect())
    assert got == sorted(["x", "", "ba\rre", "y" * 70_000, "nested"])
    assert text_lines(spark, f"file://{tmp_path}/gone").collect() == []
    for size in ("64", "1024"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        again = sorted(r.value for r in text_lines(spark, f"file://{tmp_path}/a").collect())
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert again == got


def test_delimited(spark):
    df = spark.createDataFrame([("a,1,",), ("a,1",), ("",), (None,), ("b.c,2,x",)], "value STRING")
    assert sorted(tuple(r) for r in delimited(df, ["p", "q", "r"]).collect()) == [("a", "1", ""), ("b.c", "2", "x")]
    assert {tuple(r) for r in arity_errors(df, [3]).collect()} == {(2, 1), (1, 1), (0, 1)}


@pytest.mark.parametrize("text, want", [("12", 12), ("-0", 0), ("+7", 7), (" 1", None), ("1 ", None), ("1.0", None), ("", None), (None, None), ("9223372036854775808", None), ("１", None)])
def test_int(spark, text, want):
    assert one(spark, text, strict_int) == want


def test_float_and_date(spark):
    assert [one(spark, t, strict_float) for t in ("1.5", "1d", "NaN", "1e400", ".5", None)] == [1.5, None, None, None, 0.5, None]
    assert [str(one(spark, t, strict_date)) for t in ("1978-01-31", "1978-1-1", "1978-13-01", None)] == ["1978-01-31", "None", "None", "None"]


def test_strings(spark):
    assert one(spark, "a b　 c\x0bd ", tokens) == ["a", "b", "c", "d"]
    assert one(spark, "It's KK-9!", words) == ["it", "s", "k", "9"] == one(spark, "It's KK-9!", lambda c: tokens(sanitized(c)))
    assert one(spark, "a..b.", lambda c: fields(c, ".")) == ["a", "", "b", ""]
    assert one(spark, "日本", lambda c: prefix(c, 8)) == "日本" and one(spark, "1234567890", lambda c: prefix(c, 8)) == "12345678"
    assert one(spark, "1234.5", lambda c: fixed6(c.cast("double"))) == "1234.500000"
    assert one(spark, None, tokens) is None and one(spark, "", words) == []


def test_fnv():
    assert (fnv1_values(pd.Series(["foo"])) % 100).tolist() == [99]
    assert (fnv1_values(pd.Series(["key123", "key359", "key1"])) % 3).tolist() == [0, 1, 2]
    h = 14695981039346656037
    for b in "é日".encode():
        h = h * 1099511628211 % 2**64 ^ b
    assert fnv1_values(pd.Series(["", "é日"])).tolist() == [14695981039346656037, h]


def test_fnv_bins_hold_rows(spark):
    df = spark.createDataFrame([("foo",), (None,), ("",)], "k STRING")
    assert sorted(r[0] for r in df.select(fnv1_bin(F.col("k"), 100)).collect()) == [37, 37, 99]


def test_custom_partition(spark):
    df = spark.createDataFrame([("a",), ("b",), ("ab",), (None,)], "key STRING")
    placed = shuffle.custom_partition(df, 3, F.when(F.col("key").startswith("a"), 0).when(F.col("key").isNotNull(), 2))
    assert {(r.key, r.p) for r in placed.withColumn("p", F.spark_partition_id()).collect()} == {("a", 0), ("ab", 0), ("b", 2), (None, 0)}
    assert placed.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="no such partition"):
        shuffle.custom_partition(df, 3, F.lit(3)).collect()


def test_filters(spark):
    df = spark.createDataFrame([("1999-12-31", "60"), ("2000-01-01", "50"), ("1978-13-01", "51"), (None, "x"), ("1978-1-1", None)], "d STRING, n STRING")
    assert [r.d for r in filters.before(df, "d", "2000-01-01").collect()] == ["1999-12-31", "1978-13-01", None, "1978-1-1"]
    assert [r.n for r in filters.text_above(df, "n", 50).collect()] == ["60", "51"]
    assert filters.in_list(df, "n", ["60", "60", "x"]).count() == 2 and filters.starts_with(df, "d", "1978").count() == 2
    assert filters.well_formed(df, "d", 1).count() == 4


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", None), (None, 1.0)], "k STRING, v DOUBLE")
    assert {tuple(r) for r in aggregates.sum_by(df, ["k"], F.col("v")).collect()} == {("a", 0.3), ("b", 0.0), (None, 1.0)}
    assert {r.k: r.m for r in aggregates.multi_agg(df, ["k"], m=aggregates.exact_avg(F.col("v"))).collect()} == {"a": 0.15, "b": None, None: 1.0}
    assert {r.k: r["items"] for r in aggregates.collect_by(df, ["k"], F.col("v")).collect()} == {"a": [0.1, 0.2], "b": [], None: [1.0]}


def test_join_with_clashing_names(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (2, "w")], "id INT, name STRING")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "id INT, name STRING")
    out = joins.inner_equi(a, b, "id", "id")
    assert out.columns == ["id", "name", "id_right", "name_right"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "x", 1, "p"), (1, "y", 1, "p")]


def test_union(spark):
    a, b = spark.createDataFrame([(1, "s")], "k INT, source STRING"), spark.createDataFrame([(2.5,)], "z DOUBLE")
    assert {tuple(r) for r in union_inputs(("a", a), ("b", b)).collect()} == {("a", 1, None), ("b", None, 2.5)}


def test_sink(spark, tmp_path):
    df = spark.createDataFrame([("k", 1.5, None), (None, 2.0, "x")], "k STRING, v DOUBLE, w STRING")
    write_key_value(df, f"file://{tmp_path}/out", F.col("k"), [fixed6(F.col("v")), F.col("w")])
    lines = sorted(line for p in os.listdir(tmp_path / "out") if p.startswith("part") for line in (tmp_path / "out" / p).read_text().splitlines())
    assert lines == ["\t2.000000\tx", "k\t1.500000\t"]


@pytest.mark.parametrize("separator", [",", "|", "\t", ".", "\\", "^", "a", "7", "é", "::", ".*", "日本"])
def test_fields_and_their_number(spark, separator):
    for text in ("", separator, f"x{separator}y", f"{separator}x{separator}{separator}", "none", separator * 5 + "z"):
        got = spark.createDataFrame([(text,)], "t STRING").select(fields(F.col("t"), separator), n_fields(F.col("t"), separator)).first()
        assert tuple(got) == (text.split(separator), len(text.split(separator)))
    assert one(spark, None, lambda c: n_fields(c, separator)) is None
