"""Genome bins: equal stretches of each contig with global ordinal ids, and rows assigned or replicated to them.

The dictionary has a row per contig of an assembly, so the prefix sum over it runs in one small task; everything else is column
arithmetic on the rows. Bins with too many rows are reported, not dropped: adaptive execution splits them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.tables import with_contig

#: Default length of a bin, overlap of bins, and how many times the mean makes a bin skewed.
BIN_LENGTH, BIN_OVERLAP, SKEW_FACTOR = 2_000_000, 3_000, 4


def _offsets(contigs: DataFrame, length: int) -> DataFrame:
    n = F.expr(f"(contig_length + {length - 1}) div {length}")
    counted = contigs.select("contig_id", "contig_name", "contig_length", n.alias("n_bins"))
    before = W.orderBy("contig_id").rowsBetween(W.unboundedPreceding, -1)
    return counted.withColumn("first_bin", F.coalesce(F.sum("n_bins").over(before), F.lit(0)).cast("bigint"))


def bin_table(contigs: DataFrame, length: int = BIN_LENGTH, skipped: DataFrame | None = None) -> DataFrame:
    """(bin_id, contig_id, contig_name, start_position, end_position); without the bins of ``skipped`` (bin_id)."""
    rows = _offsets(contigs, length).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bins") - 1)).alias("i"))
    rows = rows.select(
        (F.col("first_bin") + F.col("i")).alias("bin_id"), "contig_id", "contig_name", (F.col("i") * length + 1).alias("start_position"), F.least((F.col("i") + 1) * length, "contig_length").alias("end_position")
    )
    return rows.join(skipped, "bin_id", "left_anti") if skipped is not None else rows


def with_overlap(bins: DataFrame, contigs: DataFrame, length: int = BIN_LENGTH, overlap: int = BIN_OVERLAP) -> DataFrame:
    """Bins widened on both sides by the overlap, half a bin at most, within their contig."""
    wide = min(overlap, length // 2)
    ends = contigs.select("contig_id", "contig_length")
    widened = bins.join(ends, "contig_id").withColumns({"start_position": F.greatest(F.lit(1), F.col("start_position") - wide), "end_position": F.least(F.col("end_position") + wide, "contig_length")})
    return widened.select(*bins.columns)


def with_bin(rows: DataFrame, contigs: DataFrame, position: str = "contig_position", name: str = "contig_name", contig_id: str | None = "contig_id", length: int = BIN_LENGTH) -> DataFrame:
    """Add ``bin_id`` and the bin's bounds; null for an unknown contig or a position outside it."""
    placed = with_contig(rows, contigs, name, contig_id, out="_contig", code="_code")
    offsets = _offsets(contigs, length).select(F.col("contig_id").alias("_oid"), "first_bin", F.col("contig_length").alias("_clen"))
    inside = F.col(position).between(1, F.col("_clen"))
    index = F.expr(f"({position} - 1) div {length}")
    joined = placed.join(offsets, placed["_code"] == offsets["_oid"], "left")
    return joined.withColumns({"bin_id": F.when(inside, F.col("first_bin") + index), "bin_start": F.when(inside, index * length + 1), "bin_end": F.when(inside, F.least((index + 1) * length, "_clen"))}).drop("_contig", "_code", "_oid", "first_bin", "_clen")


def replicated(binned: DataFrame, position: str = "contig_position", overlap: int = BIN_OVERLAP, strict: bool = False) -> DataFrame:
    """Rows once per bin that needs them: their own, and the neighbour of the same contig whose overlap they lie in.

    ``is_owner`` marks the copy in the own bin, so results computed per bin are kept once. ``strict`` leaves the edges of the overlap out.
    """
    at, start, end = F.col(position), F.col("bin_start"), F.col("bin_end")
    back, forth = (at < start + overlap, at > end - overlap) if strict else (at <= start + overlap, at >= end - overlap)
    own = F.col("bin_id")
    copies = F.array_compact(F.array(own, F.when((start > 1) & back, own - 1), F.when((end < F.col("_length_of_contig")) & forth, own + 1)))
    rows = binned.where(own.isNotNull())
    return rows.select(*[c for c in rows.columns if c not in ("bin_id", "_length_of_contig")], own.alias("_own"), F.explode(copies).alias("bin_id")).withColumn("is_owner", F.col("_own") == F.col("bin_id")).drop("_own")


def with_replicas(rows: DataFrame, contigs: DataFrame, position: str = "contig_position", length: int = BIN_LENGTH, overlap: int = BIN_OVERLAP, strict: bool = False) -> DataFrame:
    ends = contigs.select(F.col("contig_id").alias("_eid"), F.col("contig_length").alias("_length_of_contig"))
    binned = with_contig(with_bin(rows, contigs, position, length=length), contigs, "contig_name", "contig_id", out="_c", code="_code")
    binned = binned.join(ends, binned["_code"] == ends["_eid"]).drop("_c", "_code", "_eid")
    return replicated(binned, position, overlap, strict)


def in_origin(position: Column) -> Column:
    """The row starts in the un-padded bin."""
    return position.between(F.col("bin_start"), F.col("bin_end"))


def bin_counts(binned: DataFrame) -> DataFrame:
    return binned.where(F.col("bin_id").isNotNull()).groupBy("bin_id").agg(F.count(F.lit(1)).alias("n_reads"))


def skewed_bins(counts: DataFrame, factor: int = SKEW_FACTOR) -> DataFrame:
    """Bins with more rows than ``factor`` times the (whole-number) mean of the bins that have any."""
    mean = counts.agg(F.floor(F.sum("n_reads") / F.count(F.lit(1))).alias("mean_reads"))
    return counts.join(F.broadcast(mean), F.col("n_reads") > F.col("mean_reads") * factor)  # the mean is one row
