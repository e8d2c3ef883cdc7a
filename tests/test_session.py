import os
import subprocess
import sys
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from millrace import session


def test_shared_folder_is_the_sessions(spark):
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: "hdfs://h/shared/" if key == "spark.checkpoint.dir" else other))
    assert session.shared_dir(named) == "hdfs://h/shared"
    unset = {"getConf": lambda: SimpleNamespace(get=lambda key: None), "getCheckpointDir": lambda: None, "master": "spark://m:7077"}
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: other), sparkContext=SimpleNamespace(**unset)))
    place = session.shared_dir(spark)
    assert place and place == session.shared_dir(spark)


def files(spark):
    return {f for f in os.listdir(session.shared_dir(spark).removeprefix("file://")) if f.startswith("millrace-")}


def test_written_goes_there_and_can_be_dropped(spark):
    before = files(spark)
    numbers = session.written(spark.range(5), "numbers")
    assert numbers.count() == 5 and len(files(spark) - before) == 1
    session.release(numbers)
    session.release(numbers)
    assert files(spark) == before
    with session.intermediates(spark):
        kept = session.written(spark.range(3), "a")
        assert session.written(kept, "b").count() == 3 and len(files(spark) - before) == 2
        place = session.scratch(spark, "c")
        assert place.startswith(session.shared_dir(spark)) and not os.path.exists(place.removeprefix("file://"))
    assert files(spark) == before


def test_nothing_is_left_after_the_session(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {os.getcwd()!r})
from millrace import session
spark = session.get_session(master="local[1]", **{{"spark.checkpoint.dir": "{tmp_path}/shared"}})
assert session.written(spark.range(5), "numbers").count() == 5 and session.shared_dir(spark) == "{tmp_path}/shared"
print(len(list(__import__("pathlib").Path("{tmp_path}/shared").glob("millrace-*"))))
spark.stop()
"""
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()[-1] == "1"
    for _ in range(50):
        if not list((tmp_path / "shared").glob("millrace-*")):
            return
        time.sleep(0.2)
    raise AssertionError("intermediates are left")


def test_written_keeps_the_schema_of_nothing(spark):
    back = session.written(spark.createDataFrame([], "a STRING, b ARRAY<INT>"), "empty")
    assert back.dtypes == [("a", "string"), ("b", "array<int>")] and back.count() == 0


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores
    shuffled = spark.range(100).repartition(cores + 3)
    assert session.spread(shuffled) is shuffled
    wide = spark.range(0, 100, 1, cores + 1)
    assert session.spread(wide) is wide


def test_only_what_is_small_is_broadcast(spark):
    df = spark.createDataFrame([("x" * 100,), (None,)], "a STRING")
    assert session.if_small(df, F.col("a")) is not None
    assert session.if_small(df, F.col("a"), size=131) is None and session.if_small(df, F.col("a"), size=132) is not None
    assert session.if_small(df, rows=1) is None and session.if_small(df.limit(0)) is not None
