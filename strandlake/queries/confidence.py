"""Queries on reference confidence, its blocks, and joint genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import confidence, reference
from strandlake.queries.calls import _sv
from strandlake.queries.parts import _BLOCK
from strandlake.queries.pileups import _CONSENSUS, _ELEMENTS, _consensus
from strandlake.queries.sqlparts import cigar_sum
from strandlake.session import staged
from strandlake.tables import table


def _likelihoods(spark: SparkSession, sf: str) -> DataFrame:
    refs = staged(reference.slices(_consensus(spark, sf)), "reference-slices")
    return confidence.likelihoods(*(table(spark, sf, n) for n in ("reads", "read_groups", "contigs")), refs, preset="locus_walker")


def confidence_likelihoods(spark: SparkSession, sf: str) -> DataFrame:
    return _likelihoods(spark, sf).select("sample", "contig", "position", "ref", "depth", *(F.round(c, 5).alias(c) for c in ("gl_ref", "gl_het", "gl_hom")))


def reference_confidence(spark: SparkSession, sf: str) -> DataFrame:
    got = confidence.with_genotype_quality(_likelihoods(spark, sf))
    return got.select("sample", "contig", "position", "depth", "informative", "gq", F.array_join(F.col("pl").cast("array<string>"), ",").alias("pl"))


def confidence_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = staged(confidence.with_genotype_quality(_likelihoods(spark, sf)), "confidence")
    calls = rows.where("gq = 0").select("sample", "contig", F.col("position").alias("from_position"), F.col("position").alias("to_position"))
    return confidence.blocks(rows, calls).withColumn("min_pl", F.array_join(F.col("min_pl").cast("array<string>"), ","))


def joint_likelihoods(spark: SparkSession, sf: str) -> DataFrame:
    return confidence.joint_likelihoods(table(spark, sf, "gvcf_records"), table(spark, sf, "contigs"))


def joint_genotypes(spark: SparkSession, sf: str) -> DataFrame:
    rows = confidence.joint_genotypes(staged(joint_likelihoods(spark, sf), "joint-likelihoods"))
    return rows.select("contig", "position", "ref", "alt", "sample", "gt", "gq", "depth", F.round("qual", 4).alias("qual"), "ac", "an", F.round("af", 6).alias("af"))


_NEAR = _ELEMENTS.replace("read_length, CAST(rf + o", "read_length, quals IS NOT NULL AND length(seq) = length(quals) AND length(seq) = rn AS whole, coalesce(o = 0 AND ops[i - 1] IN ('I', 'D', 'S'), FALSE) OR coalesce(o = l - 1 AND ops[i + 1] IN ('I', 'D', 'S'), FALSE) AS beside, CAST(rf + o").replace("pr AS (SELECT r.*,", f"pr AS (SELECT r.*, {cigar_sum('MIS=X')} AS rn,")
_CONF = f"""{_NEAR}, {_CONSENSUS}, ce AS (SELECT e.sample, e.contig, e.position, cons.ref, CASE WHEN is_deletion THEN 30 ELSE qual END AS q, is_deletion OR beside OR base <> cons.ref AS is_alt FROM els e JOIN cons USING (contig, position) WHERE whole),
cl AS (SELECT *, log10(1 - pow(10, q / -10.0)) AS h, log10(pow(10, q / -10.0) / 3) AS m, log10((1 - pow(10, q / -10.0)) / 2 + pow(10, q / -10.0) / 6) AS f FROM ce WHERE q > 6)"""
_K = "CASE WHEN own THEN list_position(alts, alt) ELSE list_position(alts, '<NON_REF>') END"
_JOINT = f"""{_BLOCK}, rr AS (SELECT record_id, sample_name AS sample, cname AS contig, a, b, ref_allele, CASE WHEN alt IS NULL OR alt = '.' THEN [] ELSE string_split(alt, ',') END AS alts, format_keys AS fk, genotype AS gtx FROM bl WHERE cname IS NOT NULL),
rp AS (SELECT *, list_transform(string_split({_sv('PL')}, ','), lambda x: TRY_CAST(x AS INT)) AS pl, TRY_CAST(string_split({_sv('DP')}, ',')[1] AS INT) AS depth FROM rr),
si AS (SELECT DISTINCT contig, a AS position, ref_allele AS ref, unnest(alts) AS alt FROM rp), sk AS (SELECT * FROM si WHERE alt NOT IN ('<NON_REF>', '*', '.')),
pa AS (SELECT s.*, r.record_id, r.sample, r.alts, r.pl, r.depth, r.a = s.position AND r.ref_allele = s.ref AND list_contains(r.alts, s.alt) AS own FROM sk s JOIN rp r ON r.contig = s.contig AND s.position BETWEEN r.a AND r.b),
pk AS (SELECT *, nullif(coalesce({_K}, 0), 0) AS k, (len(pl) = (len(alts) + 1) * (len(alts) + 2) / 2 OR len(pl) = (len(list_filter(alts, lambda x: x <> '<NON_REF>')) + 1) * (len(list_filter(alts, lambda x: x <> '<NON_REF>')) + 2) / 2) AND len(pl) > coalesce(nullif({_K}, 0) * (nullif({_K}, 0) + 3) / 2, 0) AS whole, row_number() OVER (PARTITION BY contig, position, ref, alt, sample ORDER BY NOT own, record_id) AS place FROM pa)"""

QUERIES = {f.__name__: f for f in (confidence_likelihoods, reference_confidence, confidence_blocks, joint_likelihoods, joint_genotypes)}

ORACLES = {
    "confidence_likelihoods": f"WITH {_CONF} SELECT sample, contig, position, ref, count(*) AS depth, round(sum(CASE WHEN is_alt THEN m ELSE h END), 5) AS gl_ref, round(sum(f), 5) AS gl_het, round(sum(CASE WHEN is_alt THEN h ELSE m END), 5) AS gl_hom FROM cl GROUP BY ALL",
    "joint_likelihoods": f"WITH {_JOINT} SELECT contig, position, ref, alt, sample, CASE WHEN whole AND k IS NOT NULL THEN pl[1] END AS pl_ref, CASE WHEN whole THEN pl[CAST(k * (k + 1) / 2 + 1 AS INT)] END AS pl_het, CASE WHEN whole THEN pl[CAST(k * (k + 3) / 2 + 1 AS INT)] END AS pl_hom, depth, own FROM pk WHERE place = 1",
}
