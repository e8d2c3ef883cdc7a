import dataclasses
import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators.filters import in_list, starts_with
from millrace.plans import cli
from millrace.plans.conf import EngineConf, byte_ranges, next_fit, reducer_count
from millrace.plans.job import Job, Pipeline, map_pairs, reduce_pairs
from millrace.plans.programs import PROGRAMS
from millrace.streaming.counts import windowed_counts

TEXT = "the test input\nthe input test\nfoo bar baz\n"
RANKS = ["u1,60,5", "u2,50,5", "u3,x,5", "u4,70", "u5,51,1", "u5,51,1"]
VISITS = ["10.0.0.123,u1,1999-01-01,0.5,a,b,c,d,1", "10.0.0.123,u2,1999-01-01,1.5,a,b,c,d,1", "1.2,u1,bad,x,a,b,c,d,1", "9.9.9.9,u1,2000-01-01,1,a,b,c,d,1", "9.9.9.9,gone,1999-01-01,1,a,b,c,d,1", "short,u1"]


def text(tmp_path, data=TEXT):
    (tmp_path / "in.txt").write_text(data)
    return f"file://{tmp_path}/in.txt"


def pairs(df):
    return sorted((r.key, str(r.value)) for r in df.collect())


def test_word_count(spark, tmp_path):
    assert pairs(PROGRAMS["wordcount"].plan(spark, text(tmp_path))) == [("bar", "1"), ("baz", "1"), ("foo", "1"), ("input", "2"), ("test", "2"), ("the", "2")]


def test_chain_and_parameters(spark, tmp_path):
    count = PROGRAMS["wordcount"].jobs[0]
    source = text(tmp_path)
    assert pairs(Pipeline([count, Job(lambda df: starts_with(df, "key", "t"))]).plan(spark, source)) == [("test", "2"), ("the", "2")]
    assert pairs(Pipeline([count, Job(lambda df: in_list(df, "key", ["foo", "bar"]))]).plan(spark, source)) == [("bar", "1"), ("foo", "1")]


def test_chain_is_one_plan(spark, tmp_path):
    plan = Pipeline([PROGRAMS["wordcount"].jobs[0], Job(lambda df: starts_with(df, "key", "t"))]).plan(spark, text(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "Aggregate" in plan and plan.count("Relation") == 1


def test_missing_input(spark, tmp_path):
    assert PROGRAMS["wordcount"].plan(spark, f"file://{tmp_path}/none").collect() == []


def test_python_mapper_and_reducer(spark):
    df = spark.createDataFrame([("", "a b a"), (None, "b"), ("", None)], "key STRING, value STRING")
    mapped = map_pairs(df, lambda k, v: ((w, "1") for w in v.split()))
    assert pairs(reduce_pairs(mapped, lambda k, values: [(k, sum(map(int, values)))])) == [("a", "2"), ("b", "2")]
    job = Job(lambda k, v: [(w, "1") for w in v.split()], lambda k, values: [(k, "first " + next(values)), (k, "again")], partitioner=lambda key, n: F.when(key == "a", 0).otherwise(n - 1), bins=3, udf=True)
    assert pairs(job.apply(df)) == [("a", "again"), ("a", "first 1"), ("b", "again"), ("b", "first 1")]


def test_reducer_may_stop_early(spark):
    df = spark.range(30_000).select((F.col("id") % 15).cast("string").alias("key"), F.lit("v").alias("value"))
    assert len(pairs(reduce_pairs(df, lambda k, values: [(k, next(values))]))) == 15


def test_failures_raise(spark):
    df = spark.createDataFrame([("", "x")], "key STRING, value STRING")
    with pytest.raises(Exception, match="ZeroDivision"):
        map_pairs(df, lambda k, v: [(k, 1 // 0)]).collect()


def test_benchmark_programs(spark, tmp_path):
    source = text(tmp_path, "\n".join(RANKS + VISITS))
    assert pairs(PROGRAMS["scan"].plan(spark, source)) == [("u1", "60"), ("u5", "51"), ("u5", "51")]
    assert pairs(PROGRAMS["aggregate"].plan(spark, source)) == [("1.2", "0.000000"), ("10.0.0.1", "2.000000"), ("9.9.9.9", "2.000000")]
    assert pairs(PROGRAMS["join"].plan(spark, source)) == [("1.2", "60.000000\t0.000000"), ("10.0.0.123", "55.000000\t1.000000")]


def test_split_size_does_not_matter(spark, tmp_path):
    source = text(tmp_path, "\n".join(RANKS * 50 + VISITS * 50))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    results = {tuple(pairs(Pipeline(PROGRAMS["join"].jobs, EngineConf(split_size=n)).plan(spark, source))) for n in (64, 1024, 128 << 20)}
    assert len(results) == 1
    # the caller's session keeps its settings; the plan's own has them
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    own = EngineConf(split_size=64, max_concurrency=3).session(spark)
    assert own.conf.get("spark.sql.files.maxPartitionBytes") == "64" and own.conf.get("spark.sql.shuffle.partitions") == "3"
    assert EngineConf(max_concurrency=999).session(spark).conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")


@pytest.mark.parametrize("program, dropped, rows", [("wordcount", 0, None), ("scan", len(VISITS) + 1, 3), ("aggregate", len(RANKS) + 1, 3), ("join", 2, 2)])
def test_a_run_reports(spark, tmp_path, program, dropped, rows):
    source = text(tmp_path, "\n".join(RANKS + VISITS) + "\n")
    pipeline = dataclasses.replace(PROGRAMS[program], conf=EngineConf(working_location=f"file://{tmp_path}/o"))
    report = pipeline.run(spark, source)
    written = [x for p in (tmp_path / "o" / "output").glob("part-*") for x in p.read_text().splitlines()]
    assert (report.lines_read, report.bytes_read, report.dropped) == (12, (tmp_path / "in.txt").stat().st_size, dropped)
    assert report.rows_written == len(written) == (rows or len(written)) and report.place == f"file://{tmp_path}/o/output" and report.seconds > 0
    assert report.bytes_written == sum(p.stat().st_size for p in (tmp_path / "o" / "output").iterdir() if p.name[0] not in "._")
    empty = pipeline.run(spark, f"file://{tmp_path}/none")
    assert (empty.lines_read, empty.bytes_read, empty.dropped, empty.rows_written) == (0, 0, 0, 0)


def test_a_plan_is_described(spark, tmp_path):
    for i, n in enumerate((3, 10, 5, 0)):
        (tmp_path / f"{i}.txt").write_text("x" * n)
    pipeline = Pipeline([], EngineConf(split_size=3, map_bin_size=6, reduce_bin_size=4))
    assert pipeline.describe(spark, f"file://{tmp_path}") == {"files": 3, "bytes": 18, "splits": 7, "map_bins": 3, "reducers": 5}
    assert pipeline.describe(spark, f"file://{tmp_path}/none")["files"] == 0


def test_a_reducers_output_goes_on_in_batches(spark, monkeypatch):
    """A reducer that yields as much as it gets holds neither."""
    from millrace.plans import job

    sizes = [len(f) for f in job._frames((str(i), i) for i in range(25_001))]
    assert sizes == [10_000, 10_000, 5_001] and list(job._frames(iter(()))) == []
    df = spark.range(25_000).select(F.lit("hot").alias("key"), F.col("id").cast("string").alias("value"))
    assert reduce_pairs(df, lambda k, values: ((k, v) for v in values)).select("value").distinct().count() == 25_000


@pytest.mark.skipif("MILLRACE_SAMPLES" not in os.environ, reason="set MILLRACE_SAMPLES to a folder with the benchmark's small rankings and visits")
def test_goldens_of_the_published_sample(spark):
    """Rows and sums that plain Python gives on the benchmark's small data set."""
    place = "file://" + os.environ["MILLRACE_SAMPLES"]
    rows = PROGRAMS["scan"].plan(spark, f"{place}/rankings").collect()
    assert (len(rows), sum(int(r.value) for r in rows)) == (185, 17_415)
    sums = {r.key: float(r.value) for r in PROGRAMS["aggregate"].plan(spark, f"{place}/visits").collect()}
    assert len(sums) == 9651 and abs(sum(sums.values()) - 4975.255069) < 1e-2 and sums["245.113."] == 2.423780 and sums["103.254."] == 2.366413
    both = {r.key: [float(x) for x in r.value.split("\t")] for r in PROGRAMS["join"].plan(spark, f"{place}/rankings", f"{place}/visits").collect()}
    assert len(both) == 7141 and sum(r for r, _ in both.values()) == 280_396 and abs(sum(v for _, v in both.values()) - 3542.987495) < 1e-2
    assert both["1.0.22.28"] == [25, 0.218458]


def test_cli(spark, tmp_path):
    assert cli.main(["wordcount", "--out", f"file://{tmp_path}/o", text(tmp_path)]) == 0
    lines = [x for p in (tmp_path / "o" / "output").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(lines) == ["bar\t1", "baz\t1", "foo\t1", "input\t2", "test\t2", "the\t2"]


def test_cli_compacts_and_explains(spark, tmp_path, capsys):
    for i in range(5):
        spark.range(i, i + 3).coalesce(1).write.parquet(f"file://{tmp_path}/in", mode="append")
    assert cli.main(["compact", "--out", f"file://{tmp_path}/o", f"file://{tmp_path}/in"]) == 0
    assert "5 files with 15 rows replaced by 1" in capsys.readouterr().err
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/o/[0-9a-f]*").collect()) == sorted(k for i in range(5) for k in range(i, i + 3))
    assert cli.main(["wordcount", "--explain", "--split-size", "10", text(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out) == {"files": 1, "bytes": len(TEXT), "splits": 5, "map_bins": 1, "reducers": 1}


def test_conf(tmp_path, monkeypatch):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"split_size": 5, "verbose": True, "working_location": "file"}))
    monkeypatch.setenv("MILLRACE_WORKING_LOCATION", "env")
    monkeypatch.setenv("MILLRACE_CLEANUP", "false")
    conf = EngineConf.load(str(file), reduce_bin_size=9, working_location=None)
    assert (conf.split_size, conf.verbose, conf.working_location, conf.cleanup, conf.reduce_bin_size) == (5, True, "env", False, 9)
    assert EngineConf(split_size=10, map_bin_size=4).split_size == 4
    assert conf.spark_settings()["spark.sql.files.maxPartitionBytes"] == "5"
    with pytest.raises(ValueError):
        EngineConf(reduce_bin_size=0)
    file.write_text('{"splitsize": 1}')
    with pytest.raises(ValueError, match="splitsize"):
        EngineConf.load(str(file))


def test_split_arithmetic():
    assert byte_ranges(3, 3) == [(0, 2)] and byte_ranges(10, 3) == [(0, 2), (3, 5), (6, 8), (9, 9)] and byte_ranges(5, 10) == [(0, 4)] and byte_ranges(0, 5) == []
    assert next_fit([], 0) == [] and next_fit([1, 2, 3], 3) == [[1, 2], [3]] and next_fit([3, 3, 1, 2, 3], 3) == [[3], [3], [1, 2], [3]]
    assert [reducer_count(n, 10) for n in (0, 9, 40, 85)] == [1, 1, 5, 10] and reducer_count(5, 0) >= 1


def test_windowed_counts_on_a_stream(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type").limit(500)
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    counts = windowed_counts(stream, "ts", "event_type", late="365000 days")
    query = counts.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    assert query.awaitTermination(120)
    batch = windowed_counts(spark.read.parquet(f"{tmp_path}/in"), "ts", "event_type")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))


def test_no_import_of_the_optional_subpackage():
    import pathlib

    root = pathlib.Path(cli.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "millrace.llm" not in path.read_text()
