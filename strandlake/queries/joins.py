"""Queries on joins by bin, sample and fragment, and on read by allele likelihoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import bins, matrix, tallies
from strandlake.queries.genome import _BINNED
from strandlake.queries.pileups import _CONSENSUS, _ELEMENTS, _STRANDS, _counts, _elements
from strandlake.tables import table


def bundle_join(spark: SparkSession, sf: str) -> DataFrame:
    """Bins with their reads (none is fine) and variants (some are needed)."""
    contigs = table(spark, sf, "contigs")
    all_bins = bins.bin_table(contigs)
    reads = bins.bin_counts(bins.with_bin(table(spark, sf, "reads"), contigs))
    variants = bins.bin_counts(bins.with_bin(table(spark, sf, "variants"), contigs)).withColumnRenamed("n_reads", "n_variants")
    return all_bins.join(reads, "bin_id", "left").join(variants, "bin_id").select("bin_id", F.coalesce("n_reads", F.lit(0)).alias("n_reads"), "n_variants")


def sample_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    """Bins of the forward and the reverse reads side by side, with bins that only one strand has."""
    binned = bins.with_bin(table(spark, sf, "reads"), table(spark, sf, "contigs")).where("bin_id is not null")
    forward = binned.where(F.col("flag").bitwiseAND(16) == 0).groupBy("bin_id", "read_group").agg(F.count(F.lit(1)).alias("forward"))
    reverse = binned.where(F.col("flag").bitwiseAND(16) != 0).groupBy("bin_id", "read_group").agg(F.count(F.lit(1)).alias("reverse"))
    joined = forward.alias("f").join(reverse.alias("r"), (F.col("f.bin_id") == F.col("r.bin_id")) & F.col("f.read_group").eqNullSafe(F.col("r.read_group")), "full_outer")
    either = lambda c: F.coalesce(F.col(f"f.{c}"), F.col(f"r.{c}")).alias(c)
    return joined.select(either("bin_id"), either("read_group"), F.coalesce("forward", F.lit(0)).alias("forward"), F.coalesce("reverse", F.lit(0)).alias("reverse"))


def mate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments by name: how many reads, first and last position, whether they begin at one place."""
    name = F.regexp_replace("read_name", "/[12]$", "")
    rows = table(spark, sf, "reads").where("contig_position >= 1")
    return rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("contig_position").alias("first_position"), F.max("contig_position").alias("last_position")).where("n > 1")


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    els = _elements(spark, sf)
    return matrix.from_elements(els, tallies.strand_tables(_counts(spark, sf)))


def likelihoods_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.normalized(_matrix(spark, sf)).groupBy("contig", "position", "allele").agg(F.round(F.sum("ll"), 5).alias("ll"), F.count(F.lit(1)).alias("n"))


def best_alleles(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.reads_by_allele(matrix.best_alleles(_matrix(spark, sf)))


def likelihoods_non_ref(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.with_non_ref(_matrix(spark, sf)).where("allele = '<NON_REF>'").groupBy("contig", "position").agg(F.round(F.sum("ll"), 5).alias("ll"))


_ROWS = f"""{_ELEMENTS}, {_CONSENSUS}, {_STRANDS}, be AS (SELECT e.*, s.ref, s.alt, pow(10, greatest(qual, 1) / -10.0) AS er FROM els e JOIN strands s USING (contig, position) WHERE base IN ('A', 'C', 'G', 'T') AND qual IS NOT NULL),
ml AS (SELECT sample, contig, position, record_id, ref AS allele, log10(CASE WHEN base = ref THEN 1 - er ELSE er / 3 END) AS ll FROM be UNION ALL SELECT sample, contig, position, record_id, alt, log10(CASE WHEN base = alt THEN 1 - er ELSE er / 3 END) FROM be),
mb AS (SELECT *, max(ll) OVER w AS bl, min(ll) OVER w AS wl FROM ml WINDOW w AS (PARTITION BY record_id, contig, position))"""
QUERIES = {f.__name__: f for f in (bundle_join, sample_full_outer, mate_pairs, likelihoods_normalized, best_alleles, likelihoods_non_ref)}

ORACLES = {
    "bundle_join": f"""WITH {_BINNED}, r AS (SELECT bin_id, count(*) AS n FROM binned WHERE bin_id IS NOT NULL GROUP BY 1), vb AS (SELECT first_bin + (contig_position - 1) // {bins.BIN_LENGTH} AS bin_id FROM (SELECT *, CASE WHEN regexp_replace(trim(contig_name), '^[cC][hH][rR]', '') = 'M' THEN 'MT' ELSE regexp_replace(trim(contig_name), '^[cC][hH][rR]', '') END AS k FROM variants) x
        JOIN known ON ckey = k JOIN firsts ON firsts.contig_id = cid WHERE contig_position BETWEEN 1 AND contig_length), v AS (SELECT bin_id, count(*) AS n FROM vb GROUP BY 1) SELECT b.bin_id, coalesce(r.n, 0) AS n_reads, v.n AS n_variants FROM bin_rows b LEFT JOIN r ON r.bin_id = b.bin_id JOIN v ON v.bin_id = b.bin_id""",
    "sample_full_outer": f"WITH {_BINNED} SELECT bin_id, read_group, count(*) FILTER (WHERE flag & 16 = 0) AS forward, count(*) FILTER (WHERE flag & 16 <> 0) AS reverse FROM binned WHERE bin_id IS NOT NULL GROUP BY ALL",
    "mate_pairs": "SELECT regexp_replace(read_name, '/[12]$', '') AS name, count(*) AS n, min(contig_position) AS first_position, max(contig_position) AS last_position FROM reads WHERE contig_position >= 1 GROUP BY 1 HAVING count(*) > 1",
    "likelihoods_normalized": f"WITH {_ROWS} SELECT contig, position, allele, round(sum(greatest(ll, bl - 4.5) - bl), 5) AS ll, count(*) AS n FROM mb GROUP BY ALL",
    "best_alleles": f"WITH {_ROWS} SELECT sample, contig, position, allele, count(*) AS depth FROM mb WHERE ll = bl AND bl - wl > 0.2 GROUP BY ALL",
    "likelihoods_non_ref": f"WITH {_ROWS}, o AS (SELECT DISTINCT record_id, contig, position, wl FROM mb) SELECT contig, position, round(sum(wl), 5) AS ll FROM o GROUP BY ALL",
}
