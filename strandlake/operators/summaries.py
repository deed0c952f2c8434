"""Summaries that merge: moments, counts with their range, depth histograms, mismatches near each other, and likelihoods of pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators.pileup import LOCUS
from strandlake.operators.somatic import MIN_QUALITY


def moments(value: Column) -> Column:
    """Aggregate: struct of n, mean and the sum of squared deviations, which ``merged_moments`` can add up."""
    x = value.cast("double")
    return F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))


def merged_moments(rows: DataFrame, keys: list[str], column: str = "m") -> DataFrame:
    """(keys, n, mean, variance) of the moments of several parts; the variance is that of a sample, null under two values."""
    part = rows.where(F.col(f"{column}.n") > 0).select(*keys, F.col(f"{column}.n").alias("_n"), F.col(f"{column}.mean").alias("_mean"), F.col(f"{column}.m2").alias("_m2"))
    total = part.groupBy(*keys).agg(F.sum("_n").alias("n"), (F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")).alias("mean"), F.sum("_m2").alias("_within"), F.sum(F.col("_n") * F.col("_mean") * F.col("_mean")).alias("_between"))
    m2 = F.col("_within") + F.col("_between") - F.col("n") * F.col("mean") * F.col("mean")
    return total.select(*keys, "n", "mean", F.when(F.col("n") > 1, F.greatest(F.lit(0.0), m2) / (F.col("n") - 1)).alias("variance"))


def count_range(rows: DataFrame, value: str) -> DataFrame:
    """One row: distinct values, the smallest and largest of them, and how many rows there are. Null values don't count."""
    per = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.count(F.lit(1)).alias("values"), F.min(value).alias("smallest"), F.max(value).alias("largest"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.max("_n").alias("most"))


def depth_histogram(counts: DataFrame) -> DataFrame:
    """(depth, positions) of ``tallies.base_counts``: how many covered positions have each depth, deletions not counted."""
    return counts.groupBy("depth").agg(F.count(F.lit(1)).alias("positions"))


def mismatch_windows(els: DataFrame, refs: DataFrame, around: int = 5) -> DataFrame:
    """(record_id, position, quality_sum): for each mismatch of a read, the qualities of its mismatches no more than ``around`` positions away, itself included."""
    return near_mismatches(els.where(F.col("base").isin("A", "C", "G", "T")).join(refs, LOCUS).where(F.col("base") != F.col("ref")), around)


def near_mismatches(wrong: DataFrame, around: int = 5) -> DataFrame:
    """``mismatch_windows`` of mismatches (record_id, position, qual)."""
    near = W.partitionBy("record_id").orderBy("position").rangeBetween(-around, around)  # the mismatches of one read
    return wrong.select("record_id", "position", F.coalesce(F.sum("qual").over(near), F.lit(0)).alias("quality_sum"))


def pool_likelihoods(els: DataFrame, sites: DataFrame, ploidy: int) -> DataFrame:
    """(sample, contig, position, ref, alt, depth, gl_0 .. gl_ploidy): log10 likelihoods of so many alternates in a pool, at sites (contig, position, ref, alt)."""
    used = els.where(F.col("base").isin("A", "C", "G", "T") & (F.col("qual") >= MIN_QUALITY)).join(sites.select(*LOCUS, "ref", "alt"), LOCUS)
    e = F.pow(F.lit(10.0), F.col("qual") / -10.0)
    of = lambda a: F.when(F.col("base") == F.col(a), 1 - e).otherwise(e / 3)
    gls = [F.sum(F.log10((1 - j / ploidy) * of("ref") + j / ploidy * of("alt"))).alias(f"gl_{j}") for j in range(ploidy + 1)]
    return used.groupBy("sample", *LOCUS, "ref", "alt").agg(F.count(F.lit(1)).alias("depth"), *gls)
