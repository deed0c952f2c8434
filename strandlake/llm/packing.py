"""Filling containers of fixed capacity with whole texts.

How many items of each length there are is all that a packing needs, and a capacity C has at most C lengths: the plan is made from
that histogram, whatever the number of documents. It takes the longest length left and fills the rest of its container
exactly, from an index of single, pair and triple sums of the lengths still available; the same combination is consumed as often as its
lengths allow. Where no combination fits exactly, the longest item that fits goes in (best fit), and the rest is tried again.
The plan says, for each length, which run of its items goes to which run of containers. Documents are numbered within their length
(in salted parts, so that a frequent length isn't one task) and look their container up.

Defined results: a text longer than the capacity fills containers alone and leaves a last piece that is packed like any item;
a text without tokens (or null) takes no room, in container 0; repeated rows are items of their own; an empty table yields no rows;
a null or non-positive capacity is an error; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.session import staged

#: A plan's histogram has a row per length; a larger capacity than this is an error rather than a large collect.
MAX_CAPACITY = 1 << 20
_RANK_BITS = 40


class Complements:
    """Index of the sums of one, two and three available lengths, as bit sets. Entries may be stale until ``refresh``, never missing."""

    def __init__(self, available: np.ndarray):
        self.available = available
        self.refresh()

    def refresh(self) -> None:
        self.lengths = np.flatnonzero(self.available)
        limit = (1 << len(self.available)) - 1
        self.singles = 0
        for x in self.lengths.tolist():
            self.singles |= 1 << x
        self.pairs = self.triples = 0
        for x in self.lengths.tolist():
            self.pairs |= (self.singles << x) & limit
        for x in self.lengths.tolist():
            self.triples |= (self.pairs << x) & limit

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """Two available lengths that fill the gap; of several, those that fill it most often."""
        half = gap // 2
        if half < 1:
            return None
        low, high = self.available[1 : half + 1], self.available[gap - half : gap][::-1]
        often = np.minimum(low, high)
        if gap % 2 == 0:
            often[half - 1] = low[half - 1] // 2
        at = int(often.argmax())
        return (gap - at - 1, at + 1) if often[at] > 0 else None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill the gap exactly."""
        if self.available[gap] > 0:
            return (gap,)
        if self.pairs >> gap & 1 and (found := self.pair(gap)):
            return found
        if not self.triples >> gap & 1:
            return None
        for x in self.lengths[self.lengths < gap][::-1].tolist():
            if self.available[x] > 0 and self.pairs >> (gap - x) & 1:
                self.available[x] -= 1
                found = self.pair(gap - x)
                self.available[x] += 1
                if found:
                    return (x, *found)
        self.refresh()  # the index said so, but the lengths ran out
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a container, how many containers are filled so); every item of the histogram is in one."""
    available = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        available[length] = n
    available[0] = 0
    index, patterns = Complements(available), []
    longest = capacity
    while longest > 0:
        if available[longest] <= 0:
            longest -= 1
            continue
        before = {longest: int(available[longest])}
        held, gap = [longest], capacity - longest
        available[longest] -= 1
        while gap > 0:
            found = index.exact(gap)
            if found is None:
                fitting = np.flatnonzero(available[: gap + 1])
                if not len(fitting):
                    break
                found = (int(fitting[-1]),)
            for x in found:
                before.setdefault(x, int(available[x]))
                available[x] -= 1
            held += found
            gap -= sum(found)
        times = min(n // held.count(x) for x, n in before.items())
        for x, n in before.items():
            available[x] = n - times * held.count(x)
        patterns.append((tuple(held), times))
    return patterns


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys (length, first rank) of the runs of items, the container of each run's first item, and the number of containers."""
    used: dict[int, int] = {}
    keys, containers, container = [], [], 0
    for lengths, times in patterns:
        for x in lengths:
            rank = used.get(x, 0)
            keys.append((x << _RANK_BITS) + rank)
            containers.append(container)
            used[x] = rank + times
        container += times
    order = np.argsort(np.array(keys, np.int64))
    return np.array(keys, np.int64)[order], np.array(containers, np.int64)[order], container


def pack(sizes: DataFrame, packs: DataFrame, doc: str = "doc_id", size: str = "n_tokens", salts: int | None = None) -> DataFrame:
    """(pack_name, doc, piece_no, token_from, n_tokens, container_id), one row per item of each capacity."""
    capacities = {r["pack_name"]: r["capacity_tokens"] for r in packs.select("pack_name", "capacity_tokens").limit(1001).collect()}
    if len(capacities) > 1000 or any(c is None or not 0 < c <= MAX_CAPACITY for c in capacities.values()):
        raise ValueError(f"at most 1000 packs, with capacities from 1 to {MAX_CAPACITY}")
    salts = salts or max(8, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = sizes.select(F.col(doc).alias("_doc"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"))
    kind = kept.schema["_doc"].dataType.simpleString()
    offered = F.array(*(F.struct(F.lit(i).alias("_pack"), F.lit(c).cast("bigint").alias("_capacity")) for i, c in enumerate(capacities.values())))
    last = F.greatest(F.lit(0), F.expr("int((_size + _capacity - 1) div _capacity - 1)"))
    items = kept.select("_doc", "_size", F.inline(offered)).select("_doc", "_size", "_pack", "_capacity", F.explode(F.sequence(F.lit(0), last)).alias("_piece"))
    begin = F.col("_piece") * F.col("_capacity")
    items = items.select("_pack", "_doc", "_piece", begin.alias("_from"), F.least(F.col("_size") - begin, "_capacity").alias("_length"), F.pmod(F.xxhash64("_doc", "_piece"), F.lit(salts)).alias("_salt"))

    cells = staged(items.groupBy("_pack", "_length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "pack-cells")
    histograms: dict[int, dict[int, int]] = {}
    for p, length, n in cells.groupBy("_pack", "_length").agg(F.sum("_n")).collect():  # a row per length at most
        histograms.setdefault(p, {})[length] = n
    table = {p: slots(plan(h, list(capacities.values())[p]))[:2] for p, h in histograms.items()}

    in_length = W.partitionBy("_pack", "_length").orderBy("_salt")
    offsets = cells.withColumn("_offset", F.sum("_n").over(in_length.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).drop("_n")
    in_salt = W.partitionBy("_pack", "_length", "_salt").orderBy("_doc", "_piece")
    ranked = items.withColumn("_rank", F.row_number().over(in_salt) - 1).join(offsets, ["_pack", "_length", "_salt"])
    ranked = ranked.select("_pack", "_doc", "_piece", "_from", "_length", (F.col("_rank") + F.col("_offset")).alias("_rank"))
    names = list(capacities)

    def placed(batches):
        for batch in batches:
            p, length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 4, 5))
            container = np.zeros(len(p), np.int64)
            for i in np.unique(p).tolist():
                keys, first = table[i]
                mine = (p == i) & (length > 0)
                key = (length[mine] << _RANK_BITS) + rank[mine]
                at = np.searchsorted(keys, key, side="right") - 1
                container[mine] = first[at] + key - keys[at]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in p.tolist()], pa.string()), *batch.columns[1:5], pa.array(container)], names=["pack_name", "doc", "piece_no", "token_from", "n_tokens", "container_id"])

    out = ranked.mapInArrow(placed, f"pack_name string, doc {kind}, piece_no int, token_from bigint, n_tokens bigint, container_id bigint")
    return out.withColumnRenamed("doc", doc)


def fills(assigned: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, container_id, capacity_tokens, used_tokens, n_items) of each container."""
    used = assigned.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("used_tokens"), F.count(F.lit(1)).alias("n_items"))
    return used.join(packs.select("pack_name", "capacity_tokens"), "pack_name").select("pack_name", "container_id", "capacity_tokens", "used_tokens", "n_items")
