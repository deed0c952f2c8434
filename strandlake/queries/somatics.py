"""Queries on regions, targets, downsampling, genotypes by base and somatic candidates.

The sample with the smallest name stands in for the normal, all others for the tumor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import periods, pileup, recal, regions, somatic, tallies
from strandlake.queries.pileups import _CONSENSUS, _ELEMENTS, _STRANDS, _consensus, _counts, _elements
from strandlake.queries.sqlparts import contig_key
from strandlake.session import staged
from strandlake.tables import table


def event_targets(spark: SparkSession, sf: str) -> DataFrame:
    return regions.targets(regions.indel_events(_elements(spark, sf), table(spark, sf, "variants")))


def _activity(spark: SparkSession, sf: str) -> DataFrame:
    t = tallies.strand_tables(_counts(spark, sf))
    alt = F.col("alt_forward") + F.col("alt_reverse")
    return t.where(alt >= 2).select("contig", "position", alt.alias("activity"))


def activity_kernel(spark: SparkSession, sf: str) -> DataFrame:
    return regions.smoothed(_activity(spark, sf))


def activity_segments(spark: SparkSession, sf: str) -> DataFrame:
    return regions.regions(activity_kernel(spark, sf), threshold=10_000)


def active_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions by likelihoods, for what has no SQL; ``activity_segments`` counts mismatches as its SQL does."""
    rows = pileup.read_rows(*(table(spark, sf, n) for n in ("reads", "read_groups", "contigs")))
    return regions.active_runs(regions.read_activity(rows), threshold=10_000)


def active_region_reads(spark: SparkSession, sf: str) -> DataFrame:
    spans = periods.read_spans(*(table(spark, sf, n) for n in ("reads", "read_groups", "contigs"))).select(F.col("contig_name").alias("contig"), "from_position", "to_position")
    return regions.region_reads(active_regions(spark, sf), spans)


def downsample_by_start(spark: SparkSession, sf: str) -> DataFrame:
    """Reads per start after the cap; which ones is up to the hash, how many is not."""
    kept = regions.capped_by_start(table(spark, sf, "reads"), ["contig_name", "contig_position"], 2)
    return kept.groupBy("contig_name", "contig_position").agg(F.count(F.lit(1)).alias("n"))


def genotype_gl(spark: SparkSession, sf: str) -> DataFrame:
    gl = somatic.genotype_likelihoods(_elements(spark, sf))
    return gl.select("sample", "contig", "position", "depth", *(F.round(f"gl_{g}", 5).alias(f"gl_{g}") for g in somatic.GENOTYPES))


def best_genotype(spark: SparkSession, sf: str) -> DataFrame:
    got = somatic.best_genotype(somatic.genotype_likelihoods(_elements(spark, sf)))
    return got.select("sample", "contig", "position", "genotype", F.round("lead", 4).alias("lead"))


def _tumor_reads(spark: SparkSession, sf: str) -> tuple[DataFrame, Column, Column]:
    """Placed reads, and which are the tumor's and the normal's."""
    first = table(spark, sf, "read_groups").agg(F.min("sample_name").alias("m")).collect()[0]["m"]  # one value
    return pileup.read_rows(*(table(spark, sf, n) for n in ("reads", "read_groups", "contigs"))), F.col("sample") != first, F.col("sample") == first


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return somatic.read_candidates(*_tumor_reads(spark, sf))


def somatic_lod(spark: SparkSession, sf: str) -> DataFrame:
    rows = _candidates(spark, sf)
    return rows.select("contig", "position", "ref", "alt", "t_ref", "t_alt", "n_ref", "n_alt", *(F.round(c, 5).alias(c) for c in ("tumor_lod", "normal_lod", "contaminant_lod", "forward_lod", "reverse_lod")))


def somatic_rejections(spark: SparkSession, sf: str) -> DataFrame:
    panel = recal.known_sites(table(spark, sf, "variants"))
    rows = staged(_candidates(spark, sf), "candidates")  # they meet themselves by position
    return somatic.judged(rows, panel).groupBy(F.concat_ws(",", "reasons").alias("reasons"), "reported", "kept").agg(F.count(F.lit(1)).alias("n"))


def somatic_power(spark: SparkSession, sf: str) -> DataFrame:
    rows = somatic.with_power(_candidates(spark, sf))
    return rows.groupBy((F.col("t_ref") + F.col("t_alt")).alias("depth")).agg(F.max(F.round("power", 9)).alias("power"), F.count(F.lit(1)).alias("n"))


_K = ", ".join(f"({o}, {w})" for o, w in regions.kernel())
_ACT = f"""{_ELEMENTS}, {_CONSENSUS}, {_STRANDS}, act AS (SELECT contig, position, alt_forward + alt_reverse AS activity FROM strands WHERE alt_forward + alt_reverse >= 2), kern(o, w) AS (VALUES {_K}),
prof AS (SELECT contig, position + o AS position, CAST(sum(activity * w) AS BIGINT) AS activity FROM act, kern WHERE position + o >= 1 GROUP BY 1, 2)"""
_SEG = """isl0 AS (SELECT *, CASE WHEN position = lag(position) OVER (PARTITION BY contig ORDER BY position) + 1 THEN 0 ELSE 1 END AS s FROM prof WHERE activity > 10000), isl1 AS (SELECT *, sum(s) OVER (PARTITION BY contig ORDER BY position) AS i FROM isl0),
isl2 AS (SELECT *, (position - min(position) OVER (PARTITION BY contig, i)) // 300 AS part FROM isl1), seg AS (SELECT contig, min(position) AS start, max(position) AS stop, max(activity) AS activity FROM isl2 GROUP BY contig, i, part)"""
_GL = "gl AS (SELECT sample, contig, position, count(*) AS depth, " + ", ".join(f"sum(log10(((CASE WHEN base = '{g[0]}' THEN 1 - e ELSE e / 3 END) + (CASE WHEN base = '{g[1]}' THEN 1 - e ELSE e / 3 END)) / 2)) AS gl_{g}" for g in somatic.GENOTYPES) + " FROM (SELECT *, pow(10, qual / -10.0) AS e FROM els WHERE base IN ('A', 'C', 'G', 'T') AND qual >= 5) GROUP BY sample, contig, position)"


def _ll(f: str) -> str:
    return f"log10(CASE WHEN base = ref THEN (1 - {f}) * (1 - e) + {f} * e / 3 WHEN base = alt THEN {f} * (1 - e) + (1 - {f}) * e / 3 ELSE e / 3 END)"


_SOM = f"""{_ELEMENTS}, {_CONSENSUS}, us AS (SELECT *, pow(10, qual / -10.0) AS e, sample <> (SELECT min(sample_name) FROM read_groups) AS is_t FROM els WHERE base IN ('A', 'C', 'G', 'T') AND qual >= 5 AND map_q > 0 AND sample IS NOT NULL),
ct AS (SELECT contig, position, base, count(*) FILTER (WHERE is_t) AS t FROM us GROUP BY ALL), cj AS (SELECT * FROM ct JOIN cons USING (contig, position)), rf AS (SELECT contig, position, ref, sum(CASE WHEN base = ref THEN t ELSE 0 END) AS rt FROM cj GROUP BY ALL),
si AS (SELECT cj.contig, cj.position, cj.ref, cj.base AS alt, t / (t + rt) AS fr FROM cj JOIN rf USING (contig, position) WHERE base <> cj.ref AND t > 0), ro AS (SELECT us.*, si.ref, si.alt, si.fr FROM us JOIN si USING (contig, position))"""

QUERIES = {f.__name__: f for f in (event_targets, activity_kernel, activity_segments, active_region_reads, downsample_by_start, genotype_gl, best_genotype, somatic_lod, somatic_rejections, somatic_power)}

ORACLES = {
    "event_targets": f"""WITH {_ELEMENTS}, ev AS (SELECT contig, position AS start, position + CASE WHEN next_op = 'D' THEN next_len ELSE 0 END AS stop FROM els WHERE next_op IN ('I', 'D') UNION SELECT {contig_key()}, CAST(contig_position AS BIGINT), CAST(contig_position + length(ref_allele) - 1 AS BIGINT) FROM variants
        WHERE len(list_filter(string_split(alt, ','), lambda a: a NOT LIKE '<%' AND a NOT IN ('*', '.') AND length(a) <> length(ref_allele))) > 0), p AS (SELECT *, max(stop) OVER (PARTITION BY contig ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM ev WHERE contig IS NOT NULL),
        i AS (SELECT *, sum(CASE WHEN ps IS NULL OR start > ps + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS isl FROM p), t AS (SELECT contig, min(start) AS start, max(stop) AS stop FROM i GROUP BY contig, isl) SELECT contig, start, CAST(stop AS BIGINT) AS stop FROM t WHERE stop - start < 500""",
    "activity_kernel": f"WITH {_ACT} SELECT contig, position, activity FROM prof",
    "activity_segments": f"WITH {_ACT}, {_SEG} SELECT contig, start, stop, activity FROM seg",
    "downsample_by_start": "SELECT contig_name, contig_position, least(count(*), 2) AS n FROM reads GROUP BY ALL",
    "genotype_gl": f"WITH {_ELEMENTS}, {_GL} SELECT sample, contig, position, depth, " + ", ".join(f"round(gl_{g}, 5) AS gl_{g}" for g in somatic.GENOTYPES) + " FROM gl",
    "best_genotype": f"WITH {_ELEMENTS}, {_GL}, l AS (" + " UNION ALL ".join(f"SELECT sample, contig, position, '{g}' AS g, round(gl_{g}, 9) AS v FROM gl" for g in somatic.GENOTYPES)
    + "), r AS (SELECT *, row_number() OVER w AS p, v - lead(v) OVER w AS ld FROM l WINDOW w AS (PARTITION BY sample, contig, position ORDER BY v DESC, g)) SELECT sample, contig, position, g AS genotype, round(ld, 4) AS lead FROM r WHERE p = 1",
    "somatic_lod": f"""WITH {_SOM} SELECT contig, position, ref, alt, count(*) FILTER (WHERE is_t AND base = ref) AS t_ref, count(*) FILTER (WHERE is_t AND base = alt) AS t_alt, count(*) FILTER (WHERE NOT is_t AND base = ref) AS n_ref, count(*) FILTER (WHERE NOT is_t AND base = alt) AS n_alt,
        round(sum({_ll('fr')} - {_ll('0.0')}) FILTER (WHERE is_t), 5) AS tumor_lod, round(coalesce(sum({_ll('0.0')} - {_ll('0.5')}) FILTER (WHERE NOT is_t), 0), 5) AS normal_lod, round(sum({_ll('0.02')} - {_ll('0.0')}) FILTER (WHERE is_t), 5) AS contaminant_lod,
        round(coalesce(sum({_ll('fr')} - {_ll('0.0')}) FILTER (WHERE is_t AND NOT is_reverse), 0), 5) AS forward_lod, round(coalesce(sum({_ll('fr')} - {_ll('0.0')}) FILTER (WHERE is_t AND is_reverse), 0), 5) AS reverse_lod FROM ro GROUP BY contig, position, ref, alt""",
}
