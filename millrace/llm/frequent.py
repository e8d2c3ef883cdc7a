"""Most frequent items by three-phase threshold counting.

1. Nodes (input partitions) count locally in bounded memory and name their leaders.
2. The leaders' sums give a lower bound for the count of a reported item. Nodes send every
   item whose local count reaches the bound's share for their rows: an item with a global
   count of at least the bound reaches its share somewhere, so none is missed.
3. The candidates are counted exactly with counts combined before the shuffle.

For a top-k the nodes' counts of the first phase are written, so the second reads them
instead of the column, and so does the third where no node had to drop anything. Where the
bound is a share of all rows it is known beforehand, and the first two phases are one pass
that writes only what is sent. Local counting keeps at most ``most`` entries between merges;
when full it keeps the ``most`` / 2 most frequent and remembers the largest dropped count as
the error, which is added to every local count, so it only ever sends too much. Candidates are at most nodes / share
in number; few (``_FEW``) are broadcast, more are told apart in the shuffle. Only where
the bound lies below that error (a top-k of a nearly flat column with more than ``most``
values on a node) are all items counted by shuffle.

Defined results: null and empty values aren't items but count as rows; ties at the end of
a top-k go to the smaller item; an empty table has no items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import if_small, written

#: A node's row without an item says how many rows it has; ``error`` is what its counts may lack.
_SENT = "item STRING, n BIGINT, lead BOOLEAN, error BIGINT, node_rows BIGINT"
_SENT_ARROW = pa.schema([("item", pa.string()), ("n", pa.int64()), ("lead", pa.bool_()), ("error", pa.int64()), ("node_rows", pa.int64())])

#: Candidates that are broadcast.
_FEW = {"rows": 20_000, "size": 2 << 20}


class LocalCounts:
    """Counts of one node. Batches are merged when they add up to ``most`` entries."""

    def __init__(self, most: int):
        self.most, self.error, self.rows = most, 0, 0
        self.parts: list[pa.Table] = []
        self.pending = 0

    def add(self, values: pa.Array) -> None:
        self.rows += len(values)
        found = pc.value_counts(values.filter(pc.not_equal(values, "")))
        self.parts.append(pa.table({"item": found.field("values"), "n": found.field("counts")}))
        self.pending += len(found)
        if self.pending >= self.most:
            self._merge()

    def _merge(self) -> None:
        table = pa.concat_tables(self.parts).group_by("item").aggregate([("n", "sum")]).rename_columns(["item", "n"])
        if table.num_rows > self.most:
            # an item dropped before may come back, so errors add up
            n, cut = table["n"].to_numpy(), table.num_rows - self.most // 2 - 1
            edge = int(np.partition(n, cut)[cut])
            table = table.filter(pc.greater(table["n"], edge))
            self.error += edge
        self.parts, self.pending = [table], 0

    def counts(self) -> pa.Table:
        """(item, n), each item once."""
        if self.parts:
            self._merge()
            return self.parts[0]
        return pa.table({"item": pa.array([], pa.string()), "n": pa.array([], pa.int64())})


def _leaders(table: pa.Table, k: int) -> np.ndarray:
    lead = np.zeros(table.num_rows, bool)
    lead[pc.select_k_unstable(table, k, [("n", "descending"), ("item", "ascending")]).to_numpy()] = True
    return lead


def _pass(items: DataFrame, most: int, chosen: Callable[[LocalCounts, pa.Table], pa.Table], k: int = 0) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = LocalCounts(most)
        for b in batches:
            local.add(b.column(0))
        table = chosen(local, local.counts())
        lead = _leaders(table, k) if k and table.num_rows else np.zeros(table.num_rows, bool)
        yield pa.RecordBatch.from_pydict({"item": [None], "n": [0], "lead": [False], "error": [local.error], "node_rows": [local.rows]}, schema=_SENT_ARROW)
        same = {"error": local.error, "node_rows": local.rows}
        columns = [table["item"], table["n"], pa.array(lead), *(pa.array(np.full(table.num_rows, x)) for x in same.values())]
        yield from pa.Table.from_arrays(columns, schema=_SENT_ARROW).to_batches(max_chunksize=100_000)

    return items.mapInArrow(work, _SENT)


def _exact(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates counted in the column."""
    wanted = written(candidates.select("item").distinct(), "candidates")
    sent = if_small(wanted, F.col("item"), **_FEW)
    return items.join(wanted if sent is None else sent, "item", "left_semi").groupBy("item").agg(F.count("*").alias("n"))


def _summed(counts: DataFrame, reaches: str) -> DataFrame:
    """The candidates (items with a local count that reaches the share) counted from complete local
    counts. Many candidates (a low bound) need no join: one sum tells who is one."""
    wanted = written(counts.where(reaches).select("item").distinct(), "candidates")
    if (sent := if_small(wanted, F.col("item"), **_FEW)) is not None:
        return counts.join(sent, "item", "left_semi").groupBy("item").agg(F.sum("n").alias("n"))
    return counts.groupBy("item").agg(F.sum("n").alias("n"), F.max(F.expr(reaches)).alias("reaches")).where("reaches").select("item", "n")


def _counted(items: DataFrame) -> DataFrame:
    """A nearly flat column: no bound tells its leaders apart, so all items are counted."""
    return items.where("item <> ''").groupBy("item").agg(F.count("*").alias("n"))


def items_above(df: DataFrame, column: str, share: float, most: int = 1 << 20) -> DataFrame:
    """(item, n): items that at least ``share`` of all rows hold, with exact counts."""
    items = df.select(F.col(column).cast("string").alias("item"))
    part = Fraction(repr(share))  # 0.005 means one in 200, not the nearest double

    def reach_share(local: LocalCounts, table: pa.Table) -> pa.Table:
        least = -(-part.numerator * local.rows // part.denominator) - local.error
        return table.filter(pc.greater_equal(table["n"], least))

    sent = written(_pass(items, most, reach_share), "leaders")
    rows, blind = sent.where("item IS NULL").agg(F.coalesce(F.sum("node_rows"), F.lit(0)), F.max(F.expr(f"error > 0 AND error * {part.denominator}BD >= node_rows * {part.numerator}BD"))).first()
    found = _counted(items) if blind else _exact(items, sent.where("item IS NOT NULL"))
    return found.where(F.col("n") * part.denominator >= part.numerator * rows)


def top_items(df: DataFrame, column: str, k: int, most: int = 1 << 20) -> DataFrame:
    """(item, n): the ``k`` most frequent items with exact counts."""
    items = df.select(F.col(column).cast("string").alias("item"))
    local = written(_pass(items, most, lambda _, table: table, k), "local")
    rows, error = local.where("item IS NULL").agg(F.coalesce(F.sum("node_rows"), F.lit(0)), F.coalesce(F.max("error"), F.lit(0))).first()
    counts = local.where("item IS NOT NULL")
    kth = counts.where("lead").groupBy("item").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(k).agg(F.min("n"), F.count("*")).first()
    bound = kth[0] if kth[1] == k else 1  # fewer leaders than k: every item counts
    share = f"{bound}BD * node_rows"
    if not local.where(f"item IS NULL AND error > 0 AND error * {rows}BD >= {share}").isEmpty():
        found = _counted(items)
    else:
        reaches = f"(n + error) * {rows}BD >= {share}"
        found = _exact(items, counts.where(reaches)) if error else _summed(counts, reaches)
    return found.orderBy(F.desc("n"), "item").limit(k)
