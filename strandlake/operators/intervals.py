"""Joins and set operations on closed intervals, at any scale.

A range join explodes both sides into bins of positions, joins on (keys, bin) and keeps a pair only in the bin where its overlap begins, so no
pair comes out twice. Merging, gaps and depth work per stretch with a carry from the stretches before (see periods.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators.periods import STRETCH, covered_periods

JOIN_BIN = 1 << 16


def _bin(position: Column, width: int) -> Column:
    return F.floor(position / width)


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_from: str, left_to: str, right_from: str, right_to: str, width: int = JOIN_BIN, how: str = "inner") -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals share a position. The right side's keys are dropped.

    how: ``inner``; ``left_semi`` or ``left_anti`` for the left rows with or without a partner (left rows need to be distinct then).
    """
    own = {c: f"_l{i}" for i, c in enumerate(left.columns)}
    theirs = {c: f"_r{i}" for i, c in enumerate(right.columns)}
    a = left.select(*(F.col(c).alias(n) for c, n in own.items()))
    b = right.select(*(F.col(c).alias(n) for c, n in theirs.items()))
    lf, lt, rf, rt = (F.col(n).cast("bigint") for n in (own[left_from], own[left_to], theirs[right_from], theirs[right_to]))
    a = a.where(lf <= lt).withColumn("_bin", F.explode(F.sequence(_bin(lf, width), _bin(lt, width))))
    b = b.where(rf <= rt).withColumn("_rbin", F.explode(F.sequence(_bin(rf, width), _bin(rt, width))))
    on = [F.col(own[k]) == F.col(theirs[k]) for k in keys] + [F.col("_bin") == F.col("_rbin")]
    overlap = (lf <= rt) & (rf <= lt)
    back = [F.col(n).alias(c) for c, n in own.items()]
    if how == "left_semi":
        return a.join(b, [*on, overlap], "left_semi").select(*back).distinct()
    if how == "left_anti":
        found = a.join(b, [*on, overlap], "left_semi").select(*back).distinct()
        return left.join(found, [left[c].eqNullSafe(found[c]) for c in left.columns], "left_anti")
    first = _bin(F.greatest(lf, rf), width) == F.col("_bin")
    joined = a.join(b, on).where(overlap & first)
    return joined.select(*back, *(F.col(n).alias(c) for c, n in theirs.items() if c not in keys))


def merged(intervals: DataFrame, keys: list[str], start: str, end: str, abutting: bool = True) -> DataFrame:
    """Overlapping intervals as one; neighbours without a gap too if ``abutting``."""
    if abutting:
        return covered_periods(intervals, keys, start, end).where("piece = 'period'").drop("piece")
    # In doubled coordinates neighbours lie one apart.
    doubled = intervals.select(*keys, (F.col(start).cast("bigint") * 2).alias("_a"), (F.col(end).cast("bigint") * 2).alias("_b"))
    periods = covered_periods(doubled, keys, "_a", "_b", 2 * STRETCH).where("piece = 'period'")
    return periods.select(*keys, F.expr("from_position div 2").alias("from_position"), F.expr("to_position div 2").alias("to_position"))


def intersected(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches in both; the inputs are merged sets (keys, from_position, to_position)."""
    other = b.withColumnsRenamed({"from_position": "_from", "to_position": "_to"})
    pairs = range_join(a, other, keys, "from_position", "to_position", "_from", "_to")
    return pairs.select(*keys, F.greatest("from_position", "_from").alias("from_position"), F.least("to_position", "_to").alias("to_position"))


def subtracted(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches of ``a`` not in ``b``; merged sets. What ``b`` leaves free within the extent of ``a`` is intersected with ``a``."""
    extent = a.groupBy(*keys).agg(F.min("from_position").alias("_lo"), F.max("to_position").alias("_hi"))
    near = b.join(extent, keys).where((F.col("from_position") <= F.col("_hi")) & (F.col("to_position") >= F.col("_lo")))
    pieces = covered_periods(near.select(*keys, "from_position", "to_position"), keys, "from_position", "to_position")
    ends = near.groupBy(*keys).agg(F.min("from_position").alias("_first"), F.max("to_position").alias("_last"))
    edge = extent.join(ends, keys, "left")
    head = edge.select(*keys, F.col("_lo").alias("from_position"), F.coalesce(F.col("_first") - 1, "_hi").alias("to_position"))
    tail = edge.where(F.col("_last").isNotNull()).select(*keys, (F.col("_last") + 1).alias("from_position"), F.col("_hi").alias("to_position"))
    free = pieces.where("piece = 'gap'").drop("piece").unionByName(head).unionByName(tail).where("from_position <= to_position")
    return intersected(a, free, keys)


def depth_runs(intervals: DataFrame, keys: list[str], start: str, end: str, stretch: int = STRETCH) -> DataFrame:
    """(keys, from_position, to_position, depth): runs of positions with equal changes of depth in between, depth above 0.

    Changes (+1 at a start, -1 after an end) are summed before the shuffle; the running sum goes per stretch, on the sum of the stretches before.
    """
    at = F.array(F.struct(F.col(start).cast("bigint").alias("at"), F.lit(1).alias("d")), F.struct((F.col(end).cast("bigint") + 1).alias("at"), F.lit(-1).alias("d")))
    changes = intervals.where(F.col(start) <= F.col(end)).select(*keys, F.inline(at)).groupBy(*keys, "at").agg(F.sum("d").alias("d")).withColumn("_stretch", _bin(F.col("at"), stretch))
    by_key = W.partitionBy(*keys).orderBy("_stretch")
    sums = changes.groupBy(*keys, "_stretch").agg(F.sum("d").alias("_sum"), F.min("at").alias("_first"))
    sums = sums.select(*keys, "_stretch", F.coalesce(F.sum("_sum").over(by_key.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(by_key).alias("_next"))
    inner = W.partitionBy(*keys, "_stretch").orderBy("at")
    runs = changes.join(sums, [*keys, "_stretch"]).select(
        *keys, F.col("at").alias("from_position"), (F.coalesce(F.lead("at").over(inner), "_next") - 1).alias("to_position"), (F.col("_before") + F.sum("d").over(inner.rowsBetween(W.unboundedPreceding, 0))).alias("depth")
    )
    return runs.where("depth > 0")


def overlap_size(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1) + 1)


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """0 if they share a position, else how far the nearer ends are apart."""
    return F.greatest(F.lit(0), F.greatest(a1, b1) - F.least(a2, b2))


def contiguous(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(a1, b1) <= F.least(a2, b2) + 1


def contains(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return (a1 <= b1) & (b2 <= a2)


def reciprocal_overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    shared = overlap_size(a1, a2, b1, b2)
    return F.least(shared / (a2 - a1 + 1), shared / (b2 - b1 + 1))


def minus(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """array<struct<from_position, to_position>>: 0, 1 or 2 pieces of a not in b."""
    left = F.struct(a1.alias("from_position"), F.least(a2, b1 - 1).alias("to_position"))
    right = F.struct(F.greatest(a1, b2 + 1).alias("from_position"), a2.alias("to_position"))
    apart = F.struct(a1.alias("from_position"), a2.alias("to_position"))
    pieces = F.when((a2 < b1) | (b2 < a1), F.array(apart)).otherwise(F.array(left, right))
    return F.filter(pieces, lambda p: p["from_position"] <= p["to_position"])


def parse_location(text: Column) -> Column:
    """struct<contig, from_position, to_position> of ``c``, ``c:n``, ``c:n+`` (to the end, null) and ``c:a-b``; commas in numbers allowed; null if malformed."""
    clean = F.regexp_replace(text, ",", "")
    pattern = r"^([^:]+)(?::(\d+)(?:(\+)|-(\d+))?)?$"
    start = F.regexp_extract(clean, pattern, 2).try_cast("bigint")
    stop = F.regexp_extract(clean, pattern, 4).try_cast("bigint")
    open_end = (F.regexp_extract(clean, pattern, 3) == "+") | start.isNull()
    to = F.when(open_end, F.lit(None).cast("bigint")).otherwise(F.coalesce(stop, start))
    found = F.struct(F.regexp_extract(clean, pattern, 1).alias("contig"), F.coalesce(start, F.lit(1)).alias("from_position"), to.alias("to_position"))
    return F.when(clean.rlike(pattern) & F.coalesce(to >= F.coalesce(start, F.lit(1)), F.lit(True)), found)


def joined_location(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """struct<from_position, to_position> of two locations that touch or overlap, else null."""
    return F.when(contiguous(a1, a2, b1, b2), endpoint_span(a1, a2, b1, b2))


def endpoint_span(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """From the first start to the last end, whatever lies between."""
    return F.struct(F.least(a1, b1).alias("from_position"), F.greatest(a2, b2).alias("to_position"))


def is_before(a2: Column, b1: Column) -> Column:
    return a2 < b1


def is_past(a1: Column, b2: Column) -> Column:
    return a1 > b2


def compared(a_contig: Column, a1: Column, a2: Column, b_contig: Column, b1: Column, b2: Column) -> Column:
    """-1, 0 or 1 in the order of contig number, start and end; a null contig (unmapped) is last."""
    big = F.lit(1 << 40)
    a, b = F.struct(F.coalesce(a_contig, big).alias("c"), a1.alias("x"), a2.alias("y")), F.struct(F.coalesce(b_contig, big).alias("c"), b1.alias("x"), b2.alias("y"))
    return F.when(a < b, -1).when(a == b, 0).otherwise(1)


def padded(a1: Column, a2: Column, padding: int, contig_length: Column) -> Column:
    """The location with ``padding`` on both sides, inside the contig."""
    return F.struct(F.greatest(F.lit(1), a1 - padding).alias("from_position"), F.least(contig_length, a2 + padding).alias("to_position"))


def location_fault(a1: Column, a2: Column, contig_length: Column) -> Column:
    """Why a location is none on its contig: ``contig`` (unknown), ``order``, ``start``, ``stop``; null for a valid one."""
    return F.when(contig_length.isNull(), "contig").when(a1 > a2, "order").when(a1 < 1, "start").when(a2 > contig_length, "stop")


def trimmed_to(rows: DataFrame, pieces: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """One row per interval of ``pieces`` (keys, from_position, to_position) that a row meets, cut to it."""
    other = pieces.withColumnsRenamed({"from_position": "_pf", "to_position": "_pt"})
    met = range_join(rows, other, keys, start, end, "_pf", "_pt", width=1 << 12)
    return met.withColumns({start: F.greatest(start, "_pf"), end: F.least(end, "_pt")}).drop("_pf", "_pt")


def owned_by(rows: DataFrame, bins: DataFrame, position: str) -> DataFrame:
    """Rows of a binned table whose position lies in the bin's own range (bins: bin_id, contig_name, from_position, to_position); copies that overlap gave to neighbours go."""
    own = bins.select(F.col("bin_id").alias("_bin_id"), F.col("from_position").alias("_of"), F.col("to_position").alias("_ot"))
    return rows.join(own, F.col("bin_id") == F.col("_bin_id")).where(F.col(position).between(F.col("_of"), F.col("_ot"))).drop("_bin_id", "_of", "_ot")
