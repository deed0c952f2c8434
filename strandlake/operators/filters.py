"""Read filters as Column predicates: true means the read is filtered out. A chain is one ``filter``; Catalyst pushes its parts down."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake import tables as t
from strandlake.functions import cigar as C


def has_flag(bits: int) -> Column:
    return F.col("flag").bitwiseAND(bits) != 0


def unmapped() -> Column:
    return has_flag(t.FLAG_UNMAPPED) | (F.col("contig_position") < 1)


def bad_mate() -> Column:
    mate = t.contig_key(F.col("mate_contig_name"))
    elsewhere = (F.trim("mate_contig_name") != "=") & mate.isNotNull() & (mate != t.contig_key(F.col("contig_name")))
    return has_flag(t.FLAG_PAIRED) & ~has_flag(t.FLAG_MATE_UNMAPPED) & ~has_flag(t.FLAG_UNMAPPED) & F.coalesce(elsewhere, F.lit(False))


def bad_cigar() -> Column:
    """Clips in the wrong place, neighbouring indels, a deletion at an end, or no aligned base."""
    text = F.col("cigar")
    broken = ~text.rlike(r"^(\d+H)?(\d+S)?(\d+[MIDNP=X])+(\d+S)?(\d+H)?$") | text.rlike(r"\d+[ID]\d+[ID]") | text.rlike(r"^(\d+[HS])*\d+D") | text.rlike(r"\d+D(\d+[HS])*$") | ~text.rlike(r"[M=X]")
    return C.has_cigar(text) & broken


def negative_start() -> Column:
    """The start, or the start with its leading soft clip, is before the contig."""
    soft = F.coalesce(F.regexp_extract("cigar", r"^(?:\d+H)?(\d+)S", 1).try_cast("int"), F.lit(0))
    return (F.col("contig_position") <= 0) | (F.col("contig_position") - soft <= 0)


def soft_clip_share() -> Column:
    total = C._sum_of(F.col("cigar"), "MIDNSHP=X")
    return F.when(total > 0, C._sum_of(F.col("cigar"), "S") / total).otherwise(F.lit(0.0))


FILTERS: dict[str, Callable[[], Column]] = {
    "unmapped": unmapped,
    "not_primary": lambda: has_flag(t.FLAG_SECONDARY),
    "supplementary": lambda: has_flag(t.FLAG_SUPPLEMENTARY),
    "duplicate": lambda: has_flag(t.FLAG_DUPLICATE),
    "vendor_fail": lambda: has_flag(t.FLAG_QC_FAIL),
    "mapq_zero": lambda: F.col("map_q") == 0,
    "mapq_unavailable": lambda: F.col("map_q") == 255,
    "mapq_below_20": lambda: F.col("map_q") < 20,
    "bad_mate": bad_mate,
    "bad_cigar": bad_cigar,
    "negative_start": negative_start,
    "heavy_soft_clip": lambda: soft_clip_share() >= 0.30,
    "insert_too_big": lambda: F.abs("inferred_size") > 3000,
    "short_read": lambda: F.length("seq") < 10,
    "no_read_group": lambda: F.col("read_group").isNull(),
    "mate_rescued": lambda: F.coalesce(F.array_contains("attributes", "XT:A:M"), F.lit(False)),
    "not_in_duplicate_stage": lambda: has_flag(3332),
}

#: The filters that each stage applies.
PRESETS: dict[str, tuple[str, ...]] = {
    "locus_walker": ("unmapped", "not_primary", "duplicate", "vendor_fail"),
    "target_creator": ("unmapped", "not_primary", "duplicate", "vendor_fail", "mapq_zero", "mapq_unavailable", "bad_mate", "bad_cigar"),
    "recalibrator": ("unmapped", "not_primary", "duplicate", "vendor_fail", "mapq_zero", "mapq_unavailable", "negative_start"),
    "active_region": ("unmapped", "not_primary", "duplicate", "vendor_fail", "mapq_below_20", "mapq_unavailable"),
    "before_genotyping": ("short_read", "mapq_below_20", "bad_mate", "no_read_group"),
    "do_not_realign": ("unmapped", "not_primary", "vendor_fail", "mapq_zero", "insert_too_big"),
}


def removed_by(name: str) -> Column:
    """The named predicate; a null (no value to judge by) keeps the read."""
    return F.coalesce(FILTERS[name](), F.lit(False))


def keep(names: tuple[str, ...] | list[str]) -> Column:
    return ~reduce(Column.__or__, (removed_by(n) for n in dict.fromkeys(names)), F.lit(False))


def filtered(reads: DataFrame, preset: str) -> DataFrame:
    return reads.where(keep(PRESETS[preset]))
