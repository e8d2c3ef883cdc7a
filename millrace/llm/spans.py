"""Long exact spans shared between records.

Every window of ``span`` code points of every text is hashed (Rabin-Karp, see
``rolling``) and counted in Spark. The hashes travel run-length packed: a run is
a series of neighbouring windows that share an anchor, and equal text gives
equal runs. Counting goes in two steps. Runs that recur whole in another record
prove all their windows shared. Where one anchor has runs of differing content
(the edges of a copied stretch, or a shared passage shorter than a window), the
single windows of one record per distinct run are hashed and counted. Repeated
windows then merge into maximal intervals per record, and the distinct sets of
records that hold a common window give the groups and the pairs.

Defined results: null texts and texts shorter than ``span`` share nothing;
repeats inside one record don't count; copies of a whole text are shared in
full; an empty table gives an empty result. Hashes are compared on 128 bits
(anchor and content).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.rolling import Hasher, code_points, window_runs
from millrace.session import release, spread, written

SPAN = 300
_RUN = "doc BIGINT, anchor BIGINT, content BIGINT, start BIGINT, windows BIGINT, times BIGINT, again BOOLEAN"
_ONE = "anchor BIGINT, content BIGINT, least BIGINT, most BIGINT, window BIGINT, at BIGINT, fresh BOOLEAN"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def runs(docs: DataFrame, span: int = SPAN, gram: int | None = None) -> DataFrame:
    """All runs of (doc BIGINT, text): one narrow pass, no shuffle."""
    gram = gram or span // 2

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = window_runs(b["text"].tolist(), span, gram)
            yield pd.DataFrame({"doc": b["doc"].to_numpy()[r["text"]], "anchor": _signed(r["anchor"]), "content": _signed(r["content"]), "start": r["start"], "windows": r["windows"], "times": r["times"], "again": r["again"]})

    long_enough = docs.where(F.length("text") >= span)
    return spread(long_enough).mapInPandas(work, _RUN)


def keep_listed(df: DataFrame, keys: DataFrame, key: str, most: int = 4_000_000) -> DataFrame:
    """Rows whose key is in a written list of distinct BIGINT keys. Up to ``most`` keys
    (some 100 MB as a hash table) are broadcast, which spares the shuffle of ``df``;
    a longer list is joined by shuffle."""
    return df.join(F.broadcast(keys) if keys.count() <= most else keys, key, "left_semi")


def _picks(classes: DataFrame) -> DataFrame:
    """One row per document; a document has at most as many runs as code points."""
    return written(classes.groupBy("doc").agg(F.collect_list(F.struct("anchor", "content", "least", "most", "start", "windows")).alias("picks")), "picks")


def _single_windows(docs: DataFrame, picks: DataFrame, span: int) -> DataFrame:
    """The windows of one representative run per class, one row each; ``fresh`` if the run hasn't had it before."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, picks in zip(b["text"], b["picks"]):
                for p in picks:
                    n, at = p["windows"], p["start"]
                    every = Hasher(code_points(text[at : at + n + span - 1])).every(span)
                    fresh = np.zeros(n, bool)
                    fresh[np.unique(every, return_index=True)[1]] = True
                    yield pd.DataFrame({"anchor": np.full(n, p["anchor"]), "content": np.full(n, p["content"]), "least": np.full(n, p["least"]), "most": np.full(n, p["most"]), "window": _signed(every), "at": np.arange(n), "fresh": fresh})

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for part in work(batches):
            held.append(part)
            rows += len(part)
            if rows > 50_000:
                yield pd.concat(held, ignore_index=True)
                held, rows = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return keep_listed(docs, picks.select("doc"), "doc").join(picks, "doc").select("text", "picks").mapInPandas(gathered, _ONE)


@dataclass
class Repeats:
    """``runs``: occurrences whose anchor more than one record has. ``classes``: their
    distinct contents with the least and the greatest record. ``windows``: single
    windows of the classes that share an anchor with another class."""

    span: int
    runs: DataFrame
    classes: DataFrame
    windows: DataFrame


def find_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int | None = None) -> Repeats:
    docs = df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where(F.col(id_col).isNotNull())
    every = written(runs(docs, span, gram), "runs")
    # an anchor counts once a record, so two say that two records have it (or one id twice)
    anchors = written(every.where("NOT again").groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    hot = written(keep_listed(every.drop("again"), anchors, "anchor"), "repeated")
    release(every, anchors)
    # any place of the least record will do; the content fixes how many windows there are
    classes = hot.groupBy("anchor", "content").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.min_by("start", "doc").alias("start"), F.min("windows").alias("windows"))
    classes = written(classes, "classes")
    mixed = classes.groupBy("anchor").agg(F.min("content").alias("c0"), F.max("content").alias("c1")).where("c0 < c1").select("anchor")
    picked = classes.join(mixed, "anchor", "left_semi").select("anchor", "content", "least", "most", F.col("least").alias("doc"), "start", "windows")
    picks = _picks(picked)
    windows = written(_single_windows(docs, picks, span), "windows")
    release(picks)
    return Repeats(span, hot, classes, windows)


def _shared_windows(found: Repeats) -> DataFrame:
    """Windows that two classes have and that lie in two records."""
    keys = (
        found.windows.groupBy("anchor", "window")
        .agg(F.min("content").alias("c0"), F.max("content").alias("c1"), F.min("least").alias("d0"), F.max("most").alias("d1"))
        .where("c0 < c1 AND d0 < d1")
        .select("anchor", "window")
    )
    return found.windows.join(keys, ["anchor", "window"], "left_semi")


def _set_sums(item: str) -> list:
    """Order-free sums that tell sets apart without collecting any."""
    return [
        F.count("*").alias("n"),
        F.sum(F.xxhash64(item).bitwiseAND(F.lit((1 << 40) - 1))).alias("s0"),
        F.bit_xor(F.xxhash64(item, F.lit(1))).alias("s1"),
        F.bit_xor(F.xxhash64(item, F.lit(2))).alias("s2"),
    ]


def _holders(found: Repeats) -> DataFrame:
    """(anchor, part, kind, doc), written: the distinct sets of two or more records that hold a common
    window, each once. Neighbouring windows mostly have the same holders."""
    # windows of mixed anchors by the set of classes that have them, one window for each set
    by_set = found.windows.where("fresh").groupBy("anchor", "window").agg(*_set_sums("content"), F.min("least").alias("d0"), F.max("most").alias("d1"), F.min("content").alias("content"))
    # equal sets of classes have one anchor, and sets of one class its content
    sets = by_set.where("d0 < d1").groupBy("n", "s0", "s1", "s2").agg(F.min("anchor").alias("anchor"), F.min("window").alias("window"), F.min("content").alias("content"))
    sets = written(sets.select("n", "anchor", "window", "content"), "sets")
    # a class holds its windows alone if no other has its anchor, or if it has a window of its own
    mixed = found.windows.select("anchor").distinct()
    alone = found.classes.where("least < most").select("anchor", "content").join(mixed, "anchor", "left_anti")
    alone = alone.unionByName(sets.where("n = 1").select("anchor", "content"))
    holds = found.runs.select("anchor", "content", "doc")
    whole = holds.join(alone, ["anchor", "content"], "left_semi").select("anchor", F.col("content").alias("part"), F.lit(0).alias("kind"), "doc")
    common = found.windows.where("fresh").join(sets.where("n > 1").select("anchor", "window"), ["anchor", "window"], "left_semi").select("anchor", "window", "content")
    edges = common.join(holds, ["anchor", "content"]).select("anchor", F.col("window").alias("part"), F.lit(1).alias("kind"), "doc")
    key = ["anchor", "part", "kind"]
    members = written(whole.unionByName(edges).distinct(), "members")
    once = members.groupBy(*key).agg(*_set_sums("doc")).groupBy("n", "s0", "s1", "s2").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
    kept = written(members.join(once, key, "left_semi"), "holders")
    release(sets, members)
    return kept


def shared_groups(found: Repeats) -> DataFrame:
    """(class_id, doc_id): the distinct sets of two or more records that hold a common stretch of
    ``span`` code points, a row a member. Two records share a stretch if and only if
    they are in one class, so this says what ``shared_pairs`` says without expanding a passage
    of many holders into all their pairs."""
    return _holders(found).select(F.xxhash64("anchor", "part", "kind").alias("class_id"), F.col("doc").alias("doc_id"))


def shared_pairs(found: Repeats, block: int = 1000) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all pairs with a common stretch of ``span`` code
    points. Its size is the result's own; pairs come only from groups that hold a
    common window, each distinct group once."""
    key = ["anchor", "part", "kind"]
    members = _holders(found)
    # large groups are cut into blocks and joined block by block, so no task makes more
    # than about block**2 pairs of one group; a group of one block isn't repeated
    blocks = members.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    cut = members.join(blocks, key).withColumn("own", F.expr("pmod(xxhash64(doc), n)").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    a = cut.select(*key, F.col("own").alias("i"), F.col("other").alias("j"), F.col("doc").alias("doc_a"))
    b = cut.select(*key, F.col("other").alias("i"), F.col("own").alias("j"), F.col("doc").alias("doc_b"))
    return a.join(b, [*key, "i", "j"]).where("doc_a < doc_b").select("doc_a", "doc_b").distinct()


def shared_intervals(found: Repeats) -> DataFrame:
    """(doc, start, end): maximal stretches of each record made of windows that some
    other record has; end is exclusive."""
    full = found.classes.where("least < most").select("anchor", "content")
    a = found.runs.join(full, ["anchor", "content"], "left_semi").select("doc", F.col("start").alias("first"), (F.col("start") + F.col("windows") * F.col("times") - 1).alias("last"))
    w = Window.partitionBy("anchor", "content").orderBy("at")
    ranges = (
        _shared_windows(found)
        .where("least = most")
        .select("anchor", "content", "at")
        .withColumn("island", F.col("at") - F.row_number().over(w))
        .groupBy("anchor", "content", "island")
        .agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    )
    # a run's repeats lie closer together than a window is long, so their stretches overlap
    last = F.col("start") + (F.col("times") - 1) * F.col("windows") + F.col("hi")
    b = found.runs.join(ranges, ["anchor", "content"]).select("doc", (F.col("start") + F.col("lo")).alias("first"), last.alias("last"))
    spans = a.unionByName(b).select("doc", F.col("first").alias("start"), (F.col("last") + found.span).alias("end"))
    return merged(spans)


def merged(spans: DataFrame) -> DataFrame:
    """Union of overlapping or touching (doc, start, end) intervals."""
    w = Window.partitionBy("doc").orderBy("start", "end")
    so_far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.when(F.col("start") <= F.col("so_far"), 0).otherwise(1)).over(w)
    return spans.withColumn("so_far", so_far).withColumn("g", group).groupBy("doc", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def shared_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """One row per record: its length, how many of its code points lie in shared
    stretches, how many stretches, the longest. Null text counts as length 0."""
    cut = shared_intervals(find_repeats(df, id_col, text_col, span))
    sums = cut.groupBy("doc").agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"), F.count("*").alias("spans"), F.max(F.col("end") - F.col("start")).alias("longest"))
    base = df.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("n_chars"))
    zero = F.lit(0).cast(T.LongType())
    return base.join(sums, "doc", "left").select(F.col("doc").alias("doc_id"), "n_chars", *[F.coalesce(c, zero).alias(c) for c in ("shared_chars", "spans", "longest")])
