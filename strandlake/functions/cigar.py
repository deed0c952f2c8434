"""CIGAR strings as Column expressions. Lengths come from one pass over the operations, inside the JVM; one too large for its type is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations that consume reference bases, read bases, and clipped bases.
REFERENCE_OPS, READ_OPS, CLIP_OPS = "MDN=X", "MIS=X", "SH"


def has_cigar(cigar: Column) -> Column:
    return cigar.isNotNull() & (cigar != "*") & (cigar != "")


def _sum_of(cigar: Column, ops: str) -> Column:
    numbers = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), F.lit(1))
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x.try_cast("bigint"))


def reference_length(cigar: Column) -> Column:
    """Sum of the M, D, N, = and X lengths."""
    return _sum_of(cigar, REFERENCE_OPS)


def read_length(cigar: Column) -> Column:
    """Sum of the M, I, S, = and X lengths."""
    return _sum_of(cigar, READ_OPS)


def leading_clip(cigar: Column) -> Column:
    """S and H bases before the first other operation."""
    return _sum_of(F.regexp_extract(cigar, r"^((?:\d+[SH])+)", 1), CLIP_OPS)


def trailing_clip(cigar: Column) -> Column:
    """S and H bases after the last other operation."""
    return _sum_of(F.regexp_extract(cigar, r"[^\dSH]((?:\d+[SH])+)$", 1), CLIP_OPS)


def operations(cigar: Column) -> Column:
    """array<struct<len int, op string>>; empty for no CIGAR."""
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int").alias("len"), F.right(p, F.lit(1)).alias("op")))
