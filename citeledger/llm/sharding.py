"""Sharding by minimax contiguous partition.

Groups of documents that must stay together (exact copies of a text) are ordered by their
least doc_id and cut into at most ``shards`` contiguous shards so that the largest shard is
as small as can be.  A binary search over the capacity asks a greedy check whether the groups
fit: each shard takes groups while they fit.  The smallest feasible capacity's greedy cuts are
the result.  A document's size is its number of characters.

The search needs no walk over all groups.  Running totals are made in parallel (a range sort by
group, totals of its parts, a sum within each part).  Then the bracket is narrowed: only groups
that cross a line of a grid of ``points`` steps are looked at, which every group larger than a
step does.  With what they tell, a greedy check can be run that reaches no further than the true
one, and one that reaches no less far: the first bounds the capacity from above, the second from
below, and both together bound where each cut can fall.  The grid is laid anew over those
windows until they hold at most ``gathered`` running totals, which alone go to one task, in 8
bytes each, whatever the sizes of the groups.

Defined cases: null and empty texts have size 0 and, as copies of each other, are two groups.
Rows that repeat a doc_id are counted each, and texts that share one are one group; so are all
rows with a null doc_id that share their text with no numbered row.  A null doc_id sorts first.
A group of size 0 joins the shard before it.  With fewer groups than shards some shards stay
unused; an empty table gives an empty result.  Other columns are not read; doc_id must be a
whole number or castable to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeledger.scratch import keep, load

SHARDS, POINTS, GATHERED = 64, 20_000, 1_000_000


def fits(totals: np.ndarray, capacity: int, shards: int) -> np.ndarray | None:
    """First running total beyond each greedy shard, or None where more than ``shards`` are needed.

    totals: running totals (ascending); of those left out none may be where a cut falls.
    """
    cuts, at, end = [], 0, int(totals[-1])
    for _ in range(shards):
        # the last group that ends within capacity
        place = int(np.searchsorted(totals, at + capacity, side="right")) - 1
        reached = int(totals[place]) if place >= 0 else 0
        if reached >= end:
            return np.array(cuts, np.int64)
        if reached <= at:
            return None  # a group larger than the capacity
        cuts.append(reached)
        at = reached
    return None


def minimax(totals: np.ndarray, shards: int, low: int, high: int) -> tuple[int, np.ndarray]:
    """(smallest feasible capacity within low..high, running totals at which its shards end)."""
    while low < high:
        middle = (low + high) // 2
        if fits(totals, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, fits(totals, low, shards)


class Bracket:
    """What some running totals tell of the search: ``points`` ascending from 0 to the total.

    ``whole[i]``: no total at which a shard may end lies between points i and i + 1.
    """

    def __init__(self, points: np.ndarray, whole: np.ndarray):
        self.points, self.whole = points, whole

    def cuts(self, capacity: int, shards: int, far: bool) -> tuple[list[int], bool]:
        """(ends of the greedy shards, whether they are enough): reaching too far, or not far enough."""
        at, end, out = 0, int(self.points[-1]), []
        for _ in range(shards):
            if at + capacity >= end:
                return out, True
            i = int(np.searchsorted(self.points, at + capacity, side="right")) - 1
            at = at + capacity if far and not self.whole[i] else max(at, int(self.points[i]))
            out.append(at)
        return out, False

    def least(self, low: int, high: int, shards: int, far: bool) -> int:
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.cuts(middle, shards, far)[1] else (middle + 1, high)
        return low


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in ascending order of their starts, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, max(a, b)))
    return out


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        if batch.num_rows:
            local = at + np.cumsum(batch.column(1).to_numpy())
            at = int(local[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, part, np.int32)), batch.column(0), batch.column(1), pa.array(local)],
                names=["part", "group_id", "size", "local"],
            )


def shard(docs: DataFrame, shards: int = SHARDS, points: int = POINTS, gathered: int = GATHERED) -> DataFrame:
    """(doc_id, group_id, size, shard, capacity): each row's shard, from 0, and the shards' least capacity."""
    if shards < 1:
        raise ValueError("there must be a shard at least")
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.md5("text"), F.lit("")).alias("copy"),
    )
    # a join that can be split, not a window: a text may have a third of all rows
    first = rows.groupBy("copy").agg(F.min("doc_id").alias("group_id"))
    grouped = keep(rows.join(first, "copy").select("doc_id", "size", "group_id"), "sized")
    groups = grouped.groupBy("group_id").agg(F.sum("size").alias("size"))
    running = keep(
        groups.repartitionByRange(F.col("group_id").asc_nulls_first())
        .sortWithinPartitions(F.col("group_id").asc_nulls_first())
        .mapInArrow(_running, "part int, group_id long, size long, local long"),
        "running",
    )
    parts = running.groupBy("part").agg(F.max("local").alias("n"), F.max("size").alias("most")).orderBy("part").collect()
    if not parts:
        return grouped.select("doc_id", "group_id", "size", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("capacity"))
    total, most = sum(p["n"] for p in parts), max(p["most"] for p in parts)
    before, at = {}, 0
    for p in parts:
        before[p["part"]] = at
        at += p["n"]
    low, high = max(-(-total // shards), most), max(-(-total // shards), most) + most
    # a few bytes for each part of the range sort
    offsets = spark.createDataFrame(list(before.items()), "part int, before long")
    placed = running.join(F.broadcast(offsets), "part").withColumn("total", F.col("local") + F.col("before"))
    real, where = np.array([0, total]), [(0, total)]

    def within(total: Column) -> Column:
        out = F.lit(False)
        for a, b in where:
            out = out | total.between(a, b)
        return out

    step = total + 1
    while total and placed.where(within(F.col("total"))).count() > gathered:
        width = sum(b - a for a, b in where)
        finer = max(1, -(-width // points))
        if finer >= step:
            break  # totals that coincide: no grid tells them apart, and distinct ones are few
        step, begin = finer, F.col("total") - F.col("size")
        crossing = F.floor(F.col("total") / step) > F.floor(begin / step)
        # at most one group for each line of the grid
        seen = placed.where(crossing & (within(F.col("total")) | within(begin))).select("total", "size").toPandas()
        ends = seen["total"].to_numpy(np.int64)
        begins = ends - seen["size"].to_numpy(np.int64)
        real = np.unique(np.concatenate([real, ends, begins]))
        known = np.unique(np.concatenate([real, *([a, b] for a, b in where)]))
        inside = np.zeros(len(known), bool)
        for a, b in where:
            inside |= (known >= a) & (known < b)
        whole = ~inside | np.isin(known, begins[seen["size"].to_numpy() > 0])
        # the edges of a window are no totals: the lesser reach does not stop there
        bracket, sure = Bracket(known, whole), Bracket(real, np.zeros(len(real), bool))
        low, high = bracket.least(low, high, shards, True), sure.least(low, high, shards, False)
        near = sure.cuts(low, shards, False)[0]
        far = bracket.cuts(high, shards, True)[0]
        far += [total] * (len(near) - len(far))
        both = [(max(a, c), min(b, d)) for a, b in merged(list(zip(near, far, strict=False))) for c, d in where]
        where = merged([(a, b) for a, b in both if a <= b])
    near = placed.where(within(F.col("total")) | (F.col("total") == total)).select("total").distinct()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy() for b in batches if b.num_rows]
        capacity, cuts = minimax(np.sort(np.concatenate(held)), shards, low, high)
        yield pa.RecordBatch.from_arrays([pa.array([capacity]), pa.array([cuts.tolist()], pa.list_(pa.int64()))], names=["capacity", "cuts"])

    found = near.repartition(1).mapInArrow(search, "capacity long, cuts array<long>").collect()[0]
    # shard ends as group ids: one row for each cut
    ends = (
        placed.where(F.col("total").isin(found["cuts"]) if found["cuts"] else F.lit(False))
        .groupBy("total").agg(F.max("group_id").alias("last")).orderBy("total").collect()
    )
    last = np.array([-(1 << 63) if e["last"] is None else e["last"] for e in ends], np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column(1).fill_null(-(1 << 63)).to_numpy()
            of = np.searchsorted(last, group, side="left")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(of.astype(np.int64)), pa.array(np.full(len(of), found["capacity"]))],
                names=["doc_id", "group_id", "size", "shard", "capacity"],
            )

    return grouped.select("doc_id", "group_id", "size").mapInArrow(
        assign, "doc_id long, group_id long, size long, shard long, capacity long"
    )


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(load(spark, sf_dir, "documents"))
