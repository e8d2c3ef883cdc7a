"""References to records that do not exist, from signed counts.

Every change is a delta on a (src, url, day) key: a listing adds one to the url's
existence on the day it starts and takes one off on the day it ends (that day is
excluded); a reference adds one to the url's references of its day, by the table ``src``
it is in; a withdrawn listing or reference comes with the sign -1. Deltas of one
key add up, so a hot url is at most as many rows as it has days; a running sum over
the days gives the existence count, and keys with references and zero existence are
the orphan report. The state is the folded deltas: ``apply_deltas`` adds those of another
day or partition, in any order, and forgets keys that came to nothing. It is kept as a
table (``session.written`` or a folder of the caller's).

Defined results: null and empty references are no cases; a reference without a date
is an orphan only if its url is never listed; listings without a url are ignored,
and one without a start is taken to hold since ever; a listing whose end isn't after
its start never holds; repeated rows count as often as stored; a reference withdrawn
before it arrives is none; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import written

#: Stands for "since ever"; before any real day.
NO_DAY = "0001-01-01"
#: Hashes of up to so many orphan keys (some 100 MB as a table) are broadcast.
MOST_HASHES = 4_000_000


def listing_deltas(pages: DataFrame, url: str = "pageurl", start: str = "listed_on", end: str = "removed_on", sign: int = 1) -> DataFrame:
    """(src, url, day, refs, exist): ``sign`` where a listing starts, its opposite where it ends; no src."""
    day0 = F.coalesce(F.col(start), F.lit(NO_DAY).cast("date"))
    held = pages.where(F.col(url).isNotNull() & (F.col(end).isNull() | (F.col(end) > day0)))
    change = F.explode(F.array(F.struct(day0.alias("day"), F.lit(sign).cast("bigint").alias("exist")), F.struct(F.col(end).alias("day"), F.lit(-sign).cast("bigint").alias("exist"))))
    rows = held.select(F.col(url).alias("url"), change.alias("d")).where("d.day IS NOT NULL")
    return rows.select(F.lit(None).cast("string").alias("src"), "url", "d.day", F.lit(0).cast("bigint").alias("refs"), "d.exist")


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """Of (src, url, day) rows; the day may be null."""
    rows = refs.where("url IS NOT NULL AND url <> ''")
    return rows.select("src", "url", "day", F.lit(sign).cast("bigint").alias("refs"), F.lit(0).cast("bigint").alias("exist"))


def fold(deltas: DataFrame) -> DataFrame:
    """Adds up the deltas of each key: the mergeable state."""
    return deltas.groupBy("src", "url", "day").agg(F.sum("refs").alias("refs"), F.sum("exist").alias("exist"))


def apply_deltas(state: DataFrame, *deltas: DataFrame) -> DataFrame:
    """The state with further deltas (or states); keys without a count are forgotten."""
    for d in deltas:
        state = state.unionByName(d)
    return fold(state).where("refs <> 0 OR exist <> 0")


def orphan_keys(state: DataFrame) -> DataFrame:
    """(src, url, day, refs): keys with references and zero existence. ``state`` is folded."""
    by_url = Window.partitionBy("url")
    until = by_url.orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # the same frame tells whether the url is ever listed, as the first day with a count is a start
    ever = F.max(F.col("exist") != 0).over(by_url)
    counted = state.withColumn("now", F.sum("exist").over(until)).withColumn("ever", ever)
    return counted.where("refs > 0 AND CASE WHEN day IS NULL THEN NOT ever ELSE now = 0 END").select("src", "url", "day", "refs")


def references(df: DataFrame, src: str, url: Column, day: str, row_id: str) -> DataFrame:
    return df.select(F.lit(src).alias("src"), F.col(row_id).cast("bigint").alias("row_id"), url.alias("url"), F.col(day).alias("day")).where("url <> ''")


def _folded(refs: DataFrame, pages: DataFrame, by_src: bool) -> DataFrame:
    own = refs.select("src" if by_src else F.lit("").alias("src"), "url", "day")
    return fold(listing_deltas(pages).unionByName(reference_deltas(own)))


def orphans(refs: DataFrame, pages: DataFrame, most: int = MOST_HASHES) -> DataFrame:
    """(src, period, row_id) of the references (src, row_id, url, day) without a listing. Of up to
    ``most`` orphan keys the hashes are broadcast, so that only references which may be
    orphans are shuffled to meet the keys themselves."""
    keys = written(orphan_keys(_folded(refs, pages, False)).select("url", "day"), "orphan_keys")
    mark = F.xxhash64("url", "day")
    maybe = refs
    if keys.count() <= most:
        maybe = refs.join(F.broadcast(keys.select(mark.alias("mark"))), mark == F.col("mark"), "left_semi")
    # a struct with a null day is no null, so plain equality serves
    k = keys.select(F.struct("url", "day").alias("key"))
    met = maybe.withColumn("key", F.struct("url", "day")).join(k, "key", "left_semi")
    period = F.coalesce(F.date_format("day", "yyyy-MM"), F.lit("none"))
    return met.select("src", period.alias("period"), "row_id")


def report(state: DataFrame) -> DataFrame:
    """(src, period, orphans, urls): the current orphans of a folded state, per table and month."""
    period = F.coalesce(F.date_format("day", "yyyy-MM"), F.lit("none"))
    by_url = orphan_keys(state).groupBy("src", period.alias("period"), "url").agg(F.sum("refs").alias("refs"))
    return by_url.groupBy("src", "period").agg(F.sum("refs").alias("orphans"), F.count("*").alias("urls"))


def orphan_report(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """The report of the references (src, row_id, url, day), from the signed counts alone."""
    return report(_folded(refs, pages, True))
