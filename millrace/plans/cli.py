"""``python -m millrace PROGRAM [--out PLACE] [-v] INPUT...`` (or spark-submit).

``compact`` consolidates the small Parquet files below the inputs into the place given;
the other programs read text. ``--explain`` says what a run would read, and runs nothing."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import functions as F

from millrace.operators.compaction import compact, listed
from millrace.plans.conf import EngineConf
from millrace.plans.programs import PROGRAMS
from millrace.session import get_session


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    parser.add_argument("program", choices=sorted([*PROGRAMS, "compact"]))
    parser.add_argument("inputs", nargs="*")
    parser.add_argument("-o", "--out", help="working location of the output")
    parser.add_argument("-v", "--verbose", action="store_true", default=None)
    parser.add_argument("--master")
    parser.add_argument("--split-size", type=int)
    parser.add_argument("--map-bin-size", type=int)
    parser.add_argument("--reduce-bin-size", type=int)
    parser.add_argument("--max-concurrency", type=int)
    parser.add_argument("--explain", action="store_true")
    parser.add_argument("--profile", metavar="PLACE", help="write Spark's event log, with times and memory of every task, to this folder")
    given = parser.parse_intermixed_args(args)
    names = ("verbose", "split_size", "map_bin_size", "reduce_bin_size", "max_concurrency")
    conf = EngineConf.load(working_location=given.out, **{n: getattr(given, n) for n in names})
    conf = conf.with_(inputs=(*conf.inputs, *given.inputs))
    events = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": given.profile} if given.profile else {}
    spark = get_session(f"millrace {given.program}", given.master, **events)
    if given.program == "compact":
        done = compact(listed(spark, *conf.inputs), conf.working_location)
        files, rows, outputs = done.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0)), F.countDistinct("out_file")).first()
        print(f"{files} files with {rows} rows replaced by {outputs}; the list is in {conf.working_location}/_replaced", file=sys.stderr)
        return 0
    pipeline = dataclasses.replace(PROGRAMS[given.program], conf=conf)
    if given.explain:
        print(json.dumps(pipeline.describe(spark)))
        return 0
    for name, value in dataclasses.asdict(pipeline.run(spark)).items():
        print(f"{name}: {value}", file=sys.stderr)
    return 0
