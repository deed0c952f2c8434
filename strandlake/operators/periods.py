"""Continuous covered periods of closed integer intervals, and the gaps between them.

``session_window`` with each row's own duration merges overlapping and touching intervals natively. It would gather all rows
of an entity in one task, so it runs per stretch of positions (by the interval's start), over at most one row per start: the
furthest end, pre-aggregated before the shuffle. What crosses stretches is then settled on one row per stretch: how far all
earlier stretches reach. Gaps come from lead within a stretch, and from the next stretch's first start at its end. No entity,
however many rows it has, becomes one task; only its list of stretches does.

Defined results: a null key is an entity of its own; intervals with a null bound or an end before the start cover nothing;
repeated intervals change nothing; an empty table yields no rows; columns other than the keys and bounds are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import cigar as C
from strandlake.session import staged
from strandlake.tables import FLAG_UNMAPPED, with_contig, with_sample

#: Positions of a stretch.
STRETCH = 1 << 20
_FAR = 10**15


def _merge_stretch(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Periods of each (keys, _stretch) by session_window; one position is one microsecond."""
    begin = F.timestamp_micros(F.col("_from"))
    # An end further away than any start can be, and than timestamps go, merges the same; the end itself is kept beside the session.
    micros = F.least(F.col("_to") - F.col("_from") + 1, F.lit(_FAR))
    length = F.make_interval(secs=(micros / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    merged = intervals.select(*keys, "_stretch", begin.alias("_at"), length.alias("_length"), "_to").groupBy(*keys, "_stretch", F.session_window("_at", F.col("_length"))).agg(F.max("_to").alias("_to"))
    return merged.select(*keys, "_stretch", F.unix_micros("session_window.start").alias("_from"), "_to")


def covered_periods(intervals: DataFrame, keys: list[str], start: str, end: str, stretch: int = STRETCH) -> DataFrame:
    """Rows (keys, piece, from_position, to_position): piece is ``period`` or ``gap``."""
    # Own names for the keys, so that no column of the input clashes with the operator's.
    inner = [f"_k{i}" for i in range(len(keys))]
    rows = intervals.select(*(F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)), F.col(start).cast("bigint").alias("_from"), F.col(end).cast("bigint").alias("_to"))
    rows = rows.where(F.col("_to") >= F.col("_from")).withColumn("_stretch", F.floor(F.col("_from") / stretch))
    furthest = rows.groupBy(*inner, "_stretch", "_from").agg(F.max("_to").alias("_to"))
    local = staged(_merge_stretch(furthest, inner), "stretch-periods")  # read three times below

    # One row per stretch: how far earlier stretches reach.
    by_key = W.partitionBy(*inner).orderBy("_stretch")
    reach = local.groupBy(*inner, "_stretch").agg(F.max("_to").alias("_reach"))
    reach = reach.withColumn("_carry", F.max("_reach").over(by_key.rowsBetween(W.unboundedPreceding, -1))).drop("_reach")
    marked = _with_stretch(local, reach, inner).withColumn("_new", F.col("_carry").isNull() | (F.col("_from") > F.col("_carry") + 1))

    # Per stretch again: its first and last new period, and how far the periods before its first new one reach.
    edges = marked.groupBy(*inner, "_stretch").agg(
        F.min(F.when(F.col("_new"), F.col("_from"))).alias("_first"), F.max(F.when(F.col("_new"), F.col("_from"))).alias("_last"), F.max(F.when(~F.col("_new"), F.col("_to"))).alias("_tail")
    )
    owner = F.last("_last", ignorenulls=True).over(by_key.rowsBetween(W.unboundedPreceding, -1))
    edges = edges.withColumn("_owner", owner)
    # The tail of a period that began in an earlier stretch extends that period: its furthest end, and the next period's start.
    tails = edges.where(F.col("_tail").isNotNull()).groupBy(*inner, F.col("_owner").alias("_last")).agg(F.max("_tail").alias("_tail_end"))
    new_edges = edges.where(F.col("_last").isNotNull()).select(*inner, "_stretch", "_first", "_last")
    new_edges = new_edges.withColumn("_next_first", F.lead("_first").over(by_key))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in inner]
    ends = new_edges.alias("a").join(tails.alias("b"), [*same, F.col("a._last") == F.col("b._last")], "left").select("a.*", "b._tail_end").drop("_first")

    periods = _with_stretch(marked.where("_new").drop("_carry", "_new"), ends, inner)
    periods = periods.withColumn("_next", F.lead("_from").over(W.partitionBy(*inner, "_stretch").orderBy("_from")))
    is_last = F.col("_from") == F.col("_last")
    periods = periods.withColumns({"_to": F.when(is_last, F.greatest("_to", F.coalesce("_tail_end", "_to"))).otherwise(F.col("_to")), "_next": F.when(is_last, F.col("_next_first")).otherwise(F.col("_next"))})
    pieces = F.array(
        F.struct(F.lit("period").alias("piece"), F.col("_from").alias("from_position"), F.col("_to").alias("to_position")),
        F.struct(F.lit("gap").alias("piece"), (F.col("_to") + 1).alias("from_position"), (F.col("_next") - 1).alias("to_position")),
    )
    pieces = F.filter(pieces, lambda p: p["to_position"].isNotNull())
    return periods.select(*(F.col(i).alias(k) for k, i in zip(keys, inner, strict=True)), F.inline(pieces))


def _with_stretch(rows: DataFrame, stretches: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of their stretch's row."""
    on: list[Column] = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_stretch"]]
    added = [c for c in stretches.columns if c not in (*keys, "_stretch")]
    return rows.alias("r").join(stretches.alias("s"), on).select("r.*", *(f"s.{c}" for c in added))


def read_spans(reads: DataFrame, read_groups: DataFrame, contigs: DataFrame) -> DataFrame:
    """(sample_name, contig_name, from_position, to_position) of the reads that are placed, have a CIGAR and a known group."""
    placed = reads.where((F.coalesce("flag", F.lit(0)).bitwiseAND(FLAG_UNMAPPED) == 0) & (F.col("contig_position") >= 1) & C.has_cigar(F.col("cigar")) & F.col("read_group").isNotNull())
    placed = placed.select("read_group", "contig_id", "contig_name", "contig_position", "cigar")
    named = with_sample(with_contig(placed, contigs, "contig_name", "contig_id", out="_contig"), read_groups, out="_sample")
    span = C.reference_length(F.col("cigar"))
    return named.where(F.col("_contig").isNotNull() & F.col("_sample").isNotNull()).select(
        F.col("_sample").alias("sample_name"), F.col("_contig").alias("contig_name"), F.col("contig_position").cast("bigint").alias("from_position"), (F.col("contig_position") + span - 1).alias("to_position")
    )


def gvcf_end() -> Column:
    """The info key END if it is a whole number not below the position, else the last position of the reference allele."""
    text = F.regexp_extract(F.coalesce("info", F.lit("")), r"(?:^|;)END=([0-9]+)(?:;|$)", 1)
    end = text.try_cast("bigint")
    return F.coalesce(F.when(end >= F.col("contig_position"), end), F.col("contig_position") + F.length("ref_allele") - 1)


def gvcf_spans(records: DataFrame, contigs: DataFrame) -> DataFrame:
    """(sample_name, contig_name, from_position, to_position) of blocks and sites."""
    named = with_contig(records.select("sample_name", "contig_name", "contig_position", "info", "ref_allele"), contigs, out="_contig").where(F.col("_contig").isNotNull())
    return named.select("sample_name", F.col("_contig").alias("contig_name"), F.col("contig_position").cast("bigint").alias("from_position"), gvcf_end().cast("bigint").alias("to_position"))


def coverage_pieces(reads: DataFrame, read_groups: DataFrame, gvcf_records: DataFrame, contigs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Periods and gaps of both tracks: (track, sample_name, contig_name, piece, from_position, to_position)."""
    both = read_spans(reads, read_groups, contigs).withColumn("track", F.lit("reads")).unionByName(gvcf_spans(gvcf_records, contigs).withColumn("track", F.lit("gvcf")))
    return covered_periods(both, ["track", "sample_name", "contig_name"], "from_position", "to_position", stretch)
