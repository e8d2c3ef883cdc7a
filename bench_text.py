"""Throughput of the benchmark programs over comma-separated text of about BENCH_GB gigabytes each
(default 1), made from the rankings and visits of BENCH_SF_DIR in a folder of this machine; prints one
JSON line. Rows are repeated whole; the join repeats visits only."""

from __future__ import annotations

import dataclasses
import json
import os
import shutil
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.plans.conf import EngineConf
from millrace.plans.programs import PROGRAMS, RANKING, VISIT
from millrace.session import folder_bytes
from millrace.tables import load


def main() -> None:
    sf, gb = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), float(os.environ.get("BENCH_GB", "1"))
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": cpus}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    place = tempfile.mkdtemp(prefix="bench-")
    try:
        for name, columns in (("rankings", RANKING), ("visits", VISIT)):
            rows = load(spark, sf, name).select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))
            rows.write.text(f"file://{place}/{name}-1")
            times = max(1, round(gb * 1e9 / folder_bytes(spark, f"file://{place}/{name}-1")))
            spread = rows.repartition(int(cpus)).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(times))))
            spread.select("value").write.text(f"file://{place}/{name}")
        out = {}
        for program, inputs in (("scan", ["rankings"]), ("aggregate", ["visits"]), ("join", ["rankings-1", "visits"])):
            pipeline = dataclasses.replace(PROGRAMS[program], conf=EngineConf(working_location=f"file://{place}/out-{program}"))
            r = pipeline.run(spark, *[f"file://{place}/{i}" for i in inputs])
            out[program] = {"seconds": round(r.seconds, 2), "gb": round(r.bytes_read / 1e9, 2), "rows_per_s": round(r.lines_read / r.seconds), "mb_per_s": round(r.bytes_read / 1e6 / r.seconds)}
        print(json.dumps(out))
    finally:
        shutil.rmtree(place)


if __name__ == "__main__":
    main()
