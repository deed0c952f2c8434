"""Parts of one read and its place against an interval, as Column expressions on contig_position, cigar, seq and base_quals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions import cigar as C
from strandlake.operators.pileup import placed_operations

#: Names that a platform goes by, and the platforms that flow bases one kind at a time.
PLATFORMS = {
    "ILLUMINA": ["ILLUMINA", "SLX", "SOLEXA"],
    "SOLID": ["SOLID"],
    "LS454": ["454", "LS454"],
    "COMPLETE_GENOMICS": ["COMPLETE"],
    "PACBIO": ["PACBIO"],
    "ION_TORRENT": ["IONTORRENT"],
    "CAPILLARY": ["CAPILLARY"],
    "HELICOS": ["HELICOS"],
}
FLOW_PLATFORMS = ["LS454", "ION_TORRENT"]
#: Fixed value: soft-clipped bases above this quality are of high quality.
HIGH_QUALITY_CLIP = 28


def platform(name: Column) -> Column:
    """The platform that a read group's text contains a name of, the first of the list; UNKNOWN for any other, null for null."""
    text, found = F.upper(name), F.when(name.isNull(), F.lit(None).cast("string"))
    for key, names in PLATFORMS.items():
        found = found.when(F.array_contains(F.array(*(text.contains(n) for n in names)), F.lit(True)), key)
    return found.otherwise("UNKNOWN")


def is_platform(name: Column, wanted: str) -> Column:
    return F.coalesce(F.upper(name).contains(wanted.upper()), F.lit(False))


def sequencer(platform_name: Column) -> Column:
    """``FLOW``, ``DISCRETE`` or ``OTHER``."""
    return F.when(platform_name.isin(FLOW_PLATFORMS), "FLOW").when(platform_name.isin("UNKNOWN", "CAPILLARY"), "OTHER").otherwise("DISCRETE")


def _clip(side: str) -> Column:
    pattern = r"^(?:\d+H)?(\d+)S" if side == "lead" else r"(\d+)S(?:\d+H)?$"
    return F.coalesce(F.regexp_extract("cigar", pattern, 1).try_cast("int"), F.lit(0))


def soft_start() -> Column:
    return F.col("contig_position") - _clip("lead")


def soft_end() -> Column:
    return F.col("contig_position") + C.reference_length(F.col("cigar")) - 1 + _clip("trail")


def unclipped_start() -> Column:
    return F.col("contig_position") - C.leading_clip(F.col("cigar"))


def unclipped_end() -> Column:
    return F.col("contig_position") + C.reference_length(F.col("cigar")) - 1 + C.trailing_clip(F.col("cigar"))


def high_quality_clips(above: int = HIGH_QUALITY_CLIP) -> Column:
    """Soft-clipped bases with a quality above the limit."""
    n = F.length("base_quals")
    text = F.concat(F.left("base_quals", _clip("lead")), F.substring("base_quals", n - _clip("trail") + 1, n))
    return F.length(F.regexp_replace(text, f"[!-{chr(33 + above)}]", ""))


def leading_insertion() -> Column:
    """Bases of an insertion that begins the read, 0 without."""
    return F.coalesce(F.regexp_extract("cigar", r"^(\d+)I", 1).try_cast("int"), F.lit(0))


def trailing_insertion() -> Column:
    return F.coalesce(F.regexp_extract("cigar", r"(\d+)I$", 1).try_cast("int"), F.lit(0))


def first_aligned_offset() -> Column:
    """Offset of the first M, = or X base in the read; null without one."""
    first = F.get(F.filter(placed_operations(F.col("cigar"), F.col("contig_position")), lambda o: o["op"].isin("M", "=", "X")), F.lit(0))
    return first["off"]


def offset_at(position: Column) -> Column:
    """Offset in the read of the base aligned to a reference position; null in a deletion and outside."""
    hit = F.filter(placed_operations(F.col("cigar"), F.col("contig_position")), lambda o: o["op"].isin("M", "=", "X") & (o["ref"] <= position) & (position < o["ref"] + o["len"]))
    op = F.get(hit, F.lit(0))
    return (op["off"] + (position - op["ref"])).cast("int")


def position_of(offset: Column) -> Column:
    """Reference position of an offset in the read; null for inserted and clipped bases."""
    hit = F.filter(placed_operations(F.col("cigar"), F.col("contig_position")), lambda o: o["op"].isin("M", "=", "X") & (o["off"] <= offset) & (offset < o["off"] + o["len"]))
    op = F.get(hit, F.lit(0))
    return op["ref"] + (offset - op["off"])


def bases_covering(first: Column, last: Column) -> Column:
    """The read's bases from one reference position to another, insertions between them too; null if either isn't aligned."""
    a, b = offset_at(first), offset_at(last)
    return F.when(a.isNotNull() & b.isNotNull(), F.substring("seq", a + 1, b - a + 1))


def overlap_class(first: Column, last: Column, same_contig: Column) -> Column:
    """How a read, with and without its clips, lies to an interval: one of nine classes."""
    s, e = soft_start(), soft_end()
    return (
        F.when(~same_contig, "NO_OVERLAP_CONTIG")
        .when(unclipped_end() < first, "NO_OVERLAP_LEFT")
        .when(unclipped_start() > last, "NO_OVERLAP_RIGHT")
        .when(e < first, "NO_OVERLAP_HARDCLIPPED_LEFT")
        .when(s > last, "NO_OVERLAP_HARDCLIPPED_RIGHT")
        .when((s >= first) & (e <= last), "OVERLAP_CONTAINED")
        .when((s < first) & (e > last), "OVERLAP_LEFT_AND_RIGHT")
        .when(s < first, "OVERLAP_LEFT")
        .otherwise("OVERLAP_RIGHT")
    )
