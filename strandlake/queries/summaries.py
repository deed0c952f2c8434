"""Queries on summaries that merge, pools, merged mates and bins without their empty ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import bins, clipping, pileup, summaries, tallies
from strandlake.queries.genome import _BINNED
from strandlake.queries.pileups import _CONSENSUS, _ELEMENTS, _STRANDS, _counts, _elements, _mismatches
from strandlake.tables import table


def quality_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Mapping qualities of each read group, from moments of both strands merged."""
    rows = table(spark, sf, "reads").where("map_q is not null")
    parts = rows.groupBy("read_group", F.col("flag").bitwiseAND(16).alias("strand")).agg(summaries.moments(F.col("map_q")).alias("m"))
    got = summaries.merged_moments(parts, ["read_group"])
    return got.select("read_group", "n", F.round("mean", 6).alias("mean"), F.round("variance", 5).alias("variance"))


def insert_size_range(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.count_range(table(spark, sf, "reads"), "inferred_size")


def depth_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.depth_histogram(tallies.base_counts(_counts(spark, sf)))


def mismatch_windows(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.near_mismatches(_mismatches(spark, sf))


def pool_likelihoods(spark: SparkSession, sf: str) -> DataFrame:
    """Each sample as a pool of four chromosomes at the sites where a base differs."""
    got = summaries.pool_likelihoods(_elements(spark, sf), tallies.strand_tables(_counts(spark, sf)), 4)
    return got.select("sample", "contig", "position", "ref", "alt", "depth", *(F.round(f"gl_{j}", 5).alias(f"gl_{j}") for j in range(5)))


def merged_mates(spark: SparkSession, sf: str) -> DataFrame:
    rows = pileup.read_rows(*(table(spark, sf, n) for n in ("reads", "read_groups", "contigs"))).where("seq not in ('', '*') and base_quals not in ('', '*')")
    return clipping.merged_mates(rows.withColumn("seq", F.upper("seq"))).select("record_id1", "record_id2", "start", "cigar", "seq", "base_quals")


def bins_with_reads(spark: SparkSession, sf: str) -> DataFrame:
    """The bin table without the bins that no read begins in."""
    ctg = table(spark, sf, "contigs")
    every = bins.bin_table(ctg)
    held = bins.with_bin(table(spark, sf, "reads"), ctg).where("bin_id is not null").select("bin_id").distinct()
    return bins.bin_table(ctg, skipped=every.select("bin_id").join(held, "bin_id", "left_anti")).select("bin_id", "start_position", "end_position")


def _gl(j: int) -> str:
    return f"round(sum(log10((1 - {j} / 4.0) * (CASE WHEN base = s.ref THEN 1 - e ELSE e / 3 END) + {j} / 4.0 * (CASE WHEN base = s.alt THEN 1 - e ELSE e / 3 END))), 5) AS gl_{j}"


QUERIES = {f.__name__: f for f in (quality_moments, insert_size_range, depth_histogram, mismatch_windows, pool_likelihoods, merged_mates, bins_with_reads)}

ORACLES = {
    "quality_moments": "SELECT read_group, count(*) AS n, round(avg(map_q), 6) AS mean, round(var_samp(map_q), 5) AS variance FROM reads WHERE map_q IS NOT NULL GROUP BY read_group",
    "insert_size_range": "WITH p AS (SELECT inferred_size, count(*) AS n FROM reads WHERE inferred_size IS NOT NULL GROUP BY 1) SELECT count(*) AS values, min(inferred_size) AS smallest, max(inferred_size) AS largest, CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM p",
    "depth_histogram": f"WITH {_ELEMENTS}, d AS (SELECT contig, position, count(*) FILTER (WHERE NOT is_deletion) AS depth FROM els GROUP BY ALL) SELECT depth, count(*) AS positions FROM d GROUP BY depth",
    "mismatch_windows": f"WITH {_ELEMENTS}, {_CONSENSUS} SELECT record_id, position, CAST(coalesce(sum(qual) OVER (PARTITION BY record_id ORDER BY position RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING), 0) AS BIGINT) AS quality_sum FROM els JOIN cons USING (contig, position) WHERE base IN ('A', 'C', 'G', 'T') AND base <> ref",
    "pool_likelihoods": f"WITH {_ELEMENTS}, {_CONSENSUS}, {_STRANDS}, u AS (SELECT *, pow(10, qual / -10.0) AS e FROM els WHERE base IN ('A', 'C', 'G', 'T') AND qual >= 5) SELECT sample, u.contig, u.position, s.ref, s.alt, count(*) AS depth, " + ", ".join(map(_gl, range(5))) + " FROM u JOIN strands s ON s.contig = u.contig AND s.position = u.position GROUP BY ALL",
    "bins_with_reads": f"WITH {_BINNED} SELECT bin_id, start_position, end_position FROM bin_rows WHERE bin_id IN (SELECT bin_id FROM binned WHERE bin_id IS NOT NULL)",
}
