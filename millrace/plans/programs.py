"""Ready-made pipelines: word count and the three benchmark queries over text inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import fixed6, prefix, strict_date, strict_float, strict_int, words
from millrace.operators.aggregates import count_by
from millrace.operators.filters import text_above
from millrace.operators.joins import inner_equi
from millrace.plans.conf import MB, EngineConf
from millrace.plans.job import Job, Pipeline
from millrace.sources.text import delimited

RANKING = ("pageurl", "pagerank", "avgduration")
VISIT = ("sourceip", "desturl", "visitdate", "adrevenue", "useragent", "countrycode", "languagecode", "searchword", "duration")


def _count_words(lines: DataFrame) -> DataFrame:
    return count_by(lines.select(F.explode(words(F.col("value"))).alias("key")), "key", name="value")


def _ranks(lines: DataFrame) -> DataFrame:
    rows = text_above(delimited(lines, RANKING), "pagerank", 50)
    return rows.select(F.col("pageurl").alias("key"), F.col("pagerank").alias("value"))


def _revenue(lines: DataFrame) -> DataFrame:
    rows = delimited(lines, VISIT).select(prefix(F.col("sourceip"), 8).alias("key"), strict_float(F.col("adrevenue")).alias("v"))
    # unparseable revenues are skipped, but their group stays
    return rows.groupBy("key").agg(fixed6(F.coalesce(F.sum("v"), F.lit(0.0))).alias("value"))


def join_visits(lines: DataFrame, cutoff: str = "2000-01-01") -> DataFrame:
    """(sourceip, pagerank, adrevenue) of visits before the cutoff with their page's rank.
    Unparseable dates count as earlier; unparseable numbers as 0. Rankings and visits may
    be mixed in the lines; the number of fields tells them apart."""
    pages = delimited(lines, RANKING).select("pageurl", F.coalesce(strict_int(F.col("pagerank")), F.lit(0)).alias("pagerank"))
    visits = delimited(lines, VISIT).where(F.coalesce(strict_date(F.col("visitdate")) < F.lit(cutoff).cast("date"), F.lit(True)))
    visits = visits.select("sourceip", "desturl", F.coalesce(strict_float(F.col("adrevenue")), F.lit(0.0)).alias("adrevenue"))
    return inner_equi(visits, pages, "desturl", "pageurl").select("sourceip", "pagerank", "adrevenue")


def _join(lines: DataFrame) -> DataFrame:
    averages = join_visits(lines).groupBy("sourceip").agg(F.avg("pagerank").alias("r"), F.avg("adrevenue").alias("v"))
    return averages.select(F.col("sourceip").alias("key"), F.concat_ws("\t", fixed6(F.col("r")), fixed6(F.col("v"))).alias("value"))


PROGRAMS = {
    "wordcount": Pipeline([Job(_count_words)]),
    "scan": Pipeline([Job(_ranks)], arity=(3,)),
    "aggregate": Pipeline([Job(_revenue)], arity=(9,)),
    "join": Pipeline([Job(_join)], EngineConf(map_bin_size=250 * MB), arity=(3, 9)),
}
