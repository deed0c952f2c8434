"""Pileups by read group, lane and sample, at one depth and in other orders; all on rows of ``pileup.elements``.

Defined results: a null read group or sample is only found by the filter for null; a lane is a read group of its name or one that begins with it and a
dot; nothing is gathered but what a result lists per locus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators import walks
from strandlake.operators.pileup import LOCUS

#: Fixed value: quality of an insertion or a deletion where the read has no tag with one.
DEFAULT_EVENT_QUALITY = 45
#: Elements that are listed by position at once.
LISTED = 1 << 20


def of_read_group(els: DataFrame, read_group: str | None) -> DataFrame:
    return els.where(F.col("read_group").eqNullSafe(F.lit(read_group)))


def of_read_groups(els: DataFrame, read_groups: list[str]) -> DataFrame:
    return els.where(F.col("read_group").isin(list(read_groups)))


def of_lane(els: DataFrame, lane: str) -> DataFrame:
    return els.where((F.col("read_group") == lane) | F.col("read_group").startswith(lane + "."))


def of_samples(els: DataFrame, samples: list[str]) -> DataFrame:
    return els.where(F.col("sample").isin(list(samples)))


def present(els: DataFrame) -> DataFrame:
    """(contig, position, read_groups, samples): the distinct names at each locus, sorted."""
    return els.groupBy(*LOCUS).agg(F.array_sort(F.collect_set("read_group")).alias("read_groups"), F.array_sort(F.collect_set("sample")).alias("samples"))


def downsampled(els: DataFrame, depth: int, seed: int = 7, salts: int = 32) -> DataFrame:
    """At most ``depth`` elements of each locus, chosen by a hash of the read.

    A locus keeps the ``depth`` smallest hashes of each salted part before the parts meet, so a deep one isn't one task.
    """
    order = F.xxhash64("record_id", F.lit(seed))
    rows = els.withColumns({"_h": order, "_salt": F.pmod(F.col("record_id"), F.lit(salts))})
    for keys in ([*LOCUS, "_salt"], LOCUS):
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_h", "record_id"))).where(F.col("_n") <= depth)
    return rows.drop("_h", "_salt", "_n")


def by_start(els: DataFrame, chunk: int = 8192) -> DataFrame:
    """(contig, position, chunk, records): the reads of each locus in the order of their start, then their id; els has ``read_start``.

    A locus deeper than ``chunk`` comes in several rows by ranges of the start, so that none grows with its depth.
    """
    depths = els.groupBy(*LOCUS).agg(F.count(F.lit(1)).alias("_n"), F.min("read_start").alias("_lo"), F.max("read_start").alias("_hi"))
    parts = F.expr(f"(_n + {chunk - 1}) div {chunk}")
    joined = els.join(depths, LOCUS).withColumn("chunk", ((F.col("read_start") - F.col("_lo")) * parts / (F.col("_hi") - F.col("_lo") + 1)).cast("int"))
    packed = joined.groupBy(*LOCUS, "chunk").agg(F.array_sort(F.collect_list(F.struct("read_start", "record_id"))).alias("r"))
    return packed.select(*LOCUS, "chunk", F.col("r.record_id").alias("records"))


def _by_start(bins: walks.Bins, chunk: int) -> Iterator[pa.RecordBatch]:
    keys, seen = None, None
    for b in bins.blocks():
        own, code = np.unique(b.key, return_inverse=True)
        start = b.of_read("read_start", 0)[b.read]
        low, high = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), np.iinfo(np.int64).min)
        np.minimum.at(low, code, start)
        np.maximum.at(high, code, start)
        more = np.stack([np.bincount(code, minlength=len(own)), low, high], axis=1)
        if keys is None:
            keys, seen = own, more
            continue
        both, code = np.unique(np.concatenate([keys, own]), return_inverse=True)
        rows = np.concatenate([seen, more])
        seen = np.stack([np.zeros(len(both), np.int64), np.full(len(both), np.iinfo(np.int64).max), np.full(len(both), np.iinfo(np.int64).min)], axis=1)
        np.add.at(seen[:, 0], code, rows[:, 0])
        np.minimum.at(seen[:, 1], code, rows[:, 1])
        np.maximum.at(seen[:, 2], code, rows[:, 2])
        keys = both
    if keys is None or not len(keys):
        return
    n, low, high = seen.T
    # Positions are listed a stretch of them at a time, each with about as many elements as a few blocks have.
    stretch = (np.cumsum(n) - 1) // LISTED
    for part in np.unique(stretch):
        first, last = (int(np.searchsorted(stretch, part, side=s)) for s in ("left", "right"))
        at, starts, ids = [], [], []
        for b in bins.blocks():
            inside = np.flatnonzero((b.key >= keys[first]) & (b.key <= keys[last - 1]))
            if len(inside):
                at.append(np.searchsorted(keys, b.key[inside]))
                starts.append(b.of_read("read_start", 0)[b.read[inside]])
                ids.append(b.rows.column("record_id").take(pa.array(b.read[inside])))
        at, starts, ids = np.concatenate(at), np.concatenate(starts), pa.concat_arrays(ids)
        number = ((starts - low[at]) * ((n[at] + chunk - 1) // chunk) / (high[at] - low[at] + 1)).astype(np.int32)
        order = np.lexsort((ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), starts, at))
        at, number, ids = at[order], number[order], ids.take(pa.array(order))
        begins = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (number[1:] != number[:-1])])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(at)].astype(np.int32)), ids)
        yield pa.RecordBatch.from_arrays([*bins.locus(keys[at[begins]]), pa.array(number[begins]), lists], names=["contig", "position", "chunk", "records"])


def reads_by_start(rows: DataFrame, chunk: int = 8192) -> DataFrame:
    """``by_start`` of placed reads (``pileup.read_rows``), from one exchange of reads."""
    return walks.walked(rows, {"record_id": F.col("record_id"), "read_start": F.col("contig_position").cast("bigint")}, lambda bins: _by_start(bins, chunk), "contig string, position bigint, chunk int, records array<bigint>")


def split(els: DataFrame, by: str = "sample") -> dict[str, Column]:
    """Conditions that take a context apart: by strand ``forward`` and ``reverse``; by sample use ``groupBy``; see ``joined``."""
    if by != "strand":
        raise ValueError("only strands have a fixed list of parts")
    return {"forward": ~F.col("is_reverse"), "reverse": F.col("is_reverse")}


def joined(parts: list[DataFrame]) -> DataFrame:
    """The elements of several contexts as one; their samples are kept apart by their column."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def next_to_soft_clip() -> Column:
    """Whether an element borders on a soft clip of its read."""
    return F.coalesce(F.col("prev_op") == "S", F.lit(False)) | F.col("before_clip")


def event_quality(tag: str) -> Column:
    """Quality of an insertion (tag ``BI``) or a deletion (``BD``) at an element, from the read's ``attributes``; the default where there is none."""
    text = F.get(F.filter("attributes", lambda t: t.startswith(f"{tag}:Z:")), F.lit(0))
    at = F.ascii(F.substring(text, F.col("read_offset") + 6, F.lit(1))) - 33
    return F.when(F.length(text) >= F.col("read_offset") + 6, at).otherwise(F.lit(DEFAULT_EVENT_QUALITY))
