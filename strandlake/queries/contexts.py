"""Queries on pileups by read group and sample, and on annotations per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import cigar as C
from strandlake.operators import annotations as A
from strandlake.operators import contexts, matrix, pileup, tallies
from strandlake.operators import variants as V
from strandlake.queries.calls import _GT, _STATS
from strandlake.queries.joins import _ROWS, _matrix
from strandlake.queries.pileups import _CONSENSUS, _ELEMENTS, _STRANDS, _counts, _elements
from strandlake.queries.sqlparts import cigar_sum
from strandlake.tables import table


def _carrying(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return pileup.elements(*(table(spark, sf, n) for n in ("reads", "read_groups", "contigs")), carried=list(columns))


def context_names(spark: SparkSession, sf: str) -> DataFrame:
    got = contexts.present(_elements(spark, sf))
    return got.select("contig", "position", F.array_join("read_groups", ",").alias("read_groups"), F.array_join("samples", ",").alias("samples"))


def context_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Elements and their positions' sum under each filter; the names are the first and last of the read group table."""
    els = _elements(spark, sf)
    names = table(spark, sf, "read_groups").agg(F.min("read_group").alias("first"), F.max("read_group").alias("last"), F.min("sample_name").alias("sample")).head()  # one row
    lane = names["first"].rsplit(".", 1)[0]
    rules = {"one_group": contexts.of_read_group(els, names["first"]), "no_group": contexts.of_read_group(els, None), "groups": contexts.of_read_groups(els, [names["first"], names["last"]]), "lane": contexts.of_lane(els, lane), "samples": contexts.of_samples(els, [names["sample"]])}
    parts = [d.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("position"), F.lit(0)).alias("positions")).withColumn("rule", F.lit(k)) for k, d in rules.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("rule", "n", "positions")


def context_downsample(spark: SparkSession, sf: str) -> DataFrame:
    return contexts.downsampled(_elements(spark, sf), 3).groupBy(*pileup.LOCUS).agg(F.count(F.lit(1)).alias("n"))


def context_by_start(spark: SparkSession, sf: str) -> DataFrame:
    got = contexts.reads_by_start(pileup.read_rows(*(table(spark, sf, n) for n in ("reads", "read_groups", "contigs"))))
    return got.select("contig", "position", "chunk", F.array_join(F.transform("records", lambda x: x.cast("string")), ",").alias("records"))


def context_split_join(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts taken apart by strand and put together again: depth of each sample at each locus."""
    els = _elements(spark, sf)
    both = contexts.joined([els.where(c) for c in contexts.split(els, "strand").values()])
    return both.groupBy("sample", *pileup.LOCUS).agg(F.count(F.lit(1)).alias("n"))


def soft_clip_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _elements(spark, sf).where(contexts.next_to_soft_clip()).groupBy(*pileup.LOCUS).agg(F.count(F.lit(1)).alias("n"))


def event_qualities(spark: SparkSession, sf: str) -> DataFrame:
    els = _carrying(spark, sf, "attributes").where("not is_deletion").withColumns({"i": contexts.event_quality("BI"), "d": contexts.event_quality("BD")})
    return els.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("insertion_quals"), F.sum("d").alias("deletion_quals"))


def strand_bias_by_sample(spark: SparkSession, sf: str) -> DataFrame:
    return A.strand_bias_by_sample(_elements(spark, sf), tallies.strand_tables(_counts(spark, sf)))


def mq0_by_sample(spark: SparkSession, sf: str) -> DataFrame:
    return A.mapping_quality_zero_by_sample(_elements(spark, sf))


def allele_balance_by_sample(spark: SparkSession, sf: str) -> DataFrame:
    got = A.allele_balance_by_sample(A.genotypes(V.decoded(table(spark, sf, "variants"))))
    return got.withColumn("ab", F.round("ab", 9))


def clipping_rank_sum(spark: SparkSession, sf: str) -> DataFrame:
    reads = table(spark, sf, "reads").withColumn("hard_clipped", C._sum_of(F.col("cigar"), "H"))
    els = pileup.elements(reads, table(spark, sf, "read_groups"), table(spark, sf, "contigs"), carried=["hard_clipped"])
    sites = tallies.strand_tables(_counts(spark, sf)).select("contig", "position", "ref", "alt")
    return A.rank_sums(els, sites).where("statistic = 'ClippingRankSum'").select("contig", "position", "n_ref", "n_alt", F.round("z", 6).alias("z"))


def likelihoods_marginal(spark: SparkSession, sf: str) -> DataFrame:
    """Alleles merged into purines and pyrimidines: a read's best likelihood within each."""
    groups = spark.createDataFrame([("A", "R"), ("G", "R"), ("C", "Y"), ("T", "Y")], "allele string, new_allele string")
    return matrix.marginalized(_matrix(spark, sf), groups).groupBy("contig", "position", "allele").agg(F.round(F.sum("ll"), 5).alias("ll"), F.count(F.lit(1)).alias("n"))


def likelihoods_well_modelled(spark: SparkSession, sf: str) -> DataFrame:
    lengths = table(spark, sf, "reads").select("record_id", F.length("seq").alias("read_length"))
    return matrix.well_modelled(_matrix(spark, sf), lengths, per_error=-0.01).groupBy("contig", "position").agg(F.count(F.lit(1)).alias("n"))


def likelihoods_overlapping(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of reads that cover the positions around their site too."""
    spans = table(spark, sf, "reads").where(C.has_cigar(F.col("cigar"))).select("record_id", F.col("contig_position").alias("from_position"), (F.col("contig_position") + C.reference_length(F.col("cigar")) - 1).alias("to_position"))
    return matrix.covering(_matrix(spark, sf), spans, 5).groupBy("contig", "position").agg(F.count(F.lit(1)).alias("n"))


def likelihoods_changed_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Reads under other ids, and one more read per site with a likelihood of its own."""
    rows = _matrix(spark, sf).select("sample", *matrix.READ, "allele", "ll")
    ids = table(spark, sf, "reads").select("record_id", (-F.col("record_id")).alias("new_id"))
    renamed = matrix.with_changed_reads(rows, ids)
    more = matrix.with_added_reads(renamed, rows.groupBy("sample", "contig", "position").agg(F.min("record_id").alias("record_id")), -1.5)
    return more.groupBy("contig", "position").agg(F.count(F.lit(1)).alias("n"), F.sum("record_id").alias("ids"), F.round(F.sum("ll"), 5).alias("ll"))


def likelihoods_per_read(spark: SparkSession, sf: str) -> DataFrame:
    got = matrix.per_read(_matrix(spark, sf))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("lls")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", F.round(e["value"], 4)))), ",")
    return got.groupBy("contig", "position", F.map_keys("lls").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("first")).select("contig", "position", "n")


def diploid_alleles(spark: SparkSession, sf: str) -> DataFrame:
    got = matrix.best_diploid(_matrix(spark, sf))
    return got.select("sample", "contig", "position", F.round("ll_ref", 5).alias("ll_ref"), F.round("ll_het", 5).alias("ll_het"), F.round("ll_alt", 5).alias("ll_alt"), "n")


_MORE = _ELEMENTS.replace("read_length, CAST(rf + o", "read_length, CAST(contig_position AS BIGINT) AS read_start, attributes, coalesce(o = 0 AND ops[i - 1] = 'S', FALSE) OR coalesce(o = l - 1 AND ops[i + 1] = 'S', FALSE) AS by_clip, CAST(rf + o")
_LANE = "regexp_replace((SELECT min(read_group) FROM read_groups), '\\.[^.]*$', '')"
_RULES = {
    "one_group": "read_group = (SELECT min(read_group) FROM read_groups)",
    "no_group": "read_group IS NULL",
    "groups": "read_group IN ((SELECT min(read_group) FROM read_groups), (SELECT max(read_group) FROM read_groups))",
    "lane": f"read_group = {_LANE} OR starts_with(read_group, {_LANE} || '.')",
    "samples": "sample = (SELECT min(sample_name) FROM read_groups)",
}
_EVENT = "CASE WHEN length({t}) >= read_offset + 6 THEN ascii(substr({t}, CAST(read_offset + 6 AS BIGINT), 1)) - 33 ELSE 45 END"
_LIST = "list_filter(attributes, lambda t: starts_with(t, '{tag}:Z:'))[1]"
_CLIP_STATS = _STATS.replace("qual, map_q, least", f"(SELECT {cigar_sum('H')} FROM reads r WHERE r.record_id = e.record_id) AS hc, qual, map_q, least").replace("SELECT contig, position, is_alt, 'BaseQRankSum' AS statistic, qual AS value FROM v UNION ALL SELECT contig, position, is_alt, 'MQRankSum', map_q FROM v UNION ALL SELECT contig, position, is_alt, 'ReadPosRankSum', ed FROM v", "SELECT contig, position, is_alt, 'ClippingRankSum' AS statistic, hc AS value FROM v")
_SPAN_END = f"contig_position + {cigar_sum('MDN=X')} - 1"

QUERIES = {
    f.__name__: f
    for f in (
        context_names, context_filters, context_downsample, context_by_start, context_split_join, soft_clip_neighbours, event_qualities, strand_bias_by_sample, mq0_by_sample, allele_balance_by_sample, clipping_rank_sum,
        likelihoods_marginal, likelihoods_well_modelled, likelihoods_overlapping, likelihoods_changed_reads, likelihoods_per_read, diploid_alleles,
    )
}

ORACLES = {
    "context_names": f"WITH {_ELEMENTS} SELECT contig, position, coalesce(array_to_string(list_sort(list_distinct(list(read_group))), ','), '') AS read_groups, coalesce(array_to_string(list_sort(list_distinct(list(sample))), ','), '') AS samples FROM els GROUP BY contig, position",
    "context_filters": f"WITH {_ELEMENTS} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS n, CAST(coalesce(sum(position), 0) AS BIGINT) AS positions FROM els WHERE {w}" for k, w in _RULES.items()),
    "context_downsample": f"WITH {_ELEMENTS} SELECT contig, position, least(count(*), 3) AS n FROM els GROUP BY contig, position",
    "context_by_start": f"WITH {_MORE} SELECT contig, position, CAST(0 AS INT) AS chunk, string_agg(CAST(record_id AS VARCHAR), ',' ORDER BY read_start, record_id) AS records FROM els GROUP BY contig, position",
    "context_split_join": f"WITH {_ELEMENTS} SELECT sample, contig, position, count(*) AS n FROM els GROUP BY ALL",
    "soft_clip_neighbours": f"WITH {_MORE} SELECT contig, position, count(*) AS n FROM els WHERE by_clip GROUP BY contig, position",
    "event_qualities": f"WITH {_MORE} SELECT sample, count(*) AS n, CAST(sum({_EVENT.format(t=_LIST.format(tag='BI'))}) AS BIGINT) AS insertion_quals, CAST(sum({_EVENT.format(t=_LIST.format(tag='BD'))}) AS BIGINT) AS deletion_quals FROM els WHERE NOT is_deletion GROUP BY sample",
    "strand_bias_by_sample": f"WITH {_ELEMENTS}, {_CONSENSUS}, {_STRANDS} SELECT sample, contig, position, " + ", ".join(f"count(*) FILTER (WHERE base = s.{a} AND {'' if r == 'reverse' else 'NOT '}is_reverse) AS {a}_{r}" for a in ("ref", "alt") for r in ("forward", "reverse")) + " FROM els JOIN strands s USING (contig, position) GROUP BY ALL",
    "mq0_by_sample": f"WITH {_ELEMENTS} SELECT sample, contig, position, count(*) AS mq0 FROM els WHERE map_q = 0 GROUP BY ALL",
    "allele_balance_by_sample": f"WITH {_GT} SELECT record_id, sample_name, round(ad[1] / (ad[1] + ad[list_max(gt) + 1]), 9) AS ab FROM gts WHERE len(gt) = 2 AND list_min(gt) = 0 AND list_max(gt) > 0 AND ad[1] + ad[list_max(gt) + 1] > 0",
    "clipping_rank_sum": f"WITH {_ELEMENTS}, {_CONSENSUS}, {_STRANDS}, {_CLIP_STATS} SELECT contig, position, n_ref, n_alt, CASE WHEN var_ > 0 THEN round((w - n_alt * (n_alt + 1) / 2 - n_alt * n_ref / 2) / sqrt(var_), 6) END AS z FROM va",
    "likelihoods_marginal": f"WITH {_ROWS}, g AS (SELECT sample, contig, position, record_id, CASE WHEN allele IN ('A', 'G') THEN 'R' ELSE 'Y' END AS allele, max(ll) AS ll FROM ml GROUP BY ALL) SELECT contig, position, allele, round(sum(ll), 5) AS ll, count(*) AS n FROM g GROUP BY ALL",
    "likelihoods_well_modelled": f"WITH {_ROWS} SELECT contig, position, count(*) AS n FROM mb JOIN (SELECT record_id, length(seq) AS n_bases FROM reads) USING (record_id) WHERE bl >= least(2.0, ceil(n_bases * 0.02)) * -0.01 GROUP BY ALL",
    "likelihoods_overlapping": f"WITH {_ROWS} SELECT contig, position, count(*) AS n FROM mb JOIN (SELECT record_id, contig_position AS a, {_SPAN_END} AS b FROM reads) USING (record_id) WHERE position - 5 >= a AND position + 5 <= b GROUP BY ALL",
    "likelihoods_changed_reads": f"""WITH {_ROWS}, c AS (SELECT sample, contig, position, -record_id AS record_id, allele, ll FROM ml), f AS (SELECT sample, contig, position, min(record_id) AS record_id FROM ml GROUP BY ALL),
        a AS (SELECT f.*, al.allele, -1.5 AS ll FROM f JOIN (SELECT DISTINCT sample, contig, position, allele FROM c) al ON al.contig = f.contig AND al.position = f.position AND al.sample IS NOT DISTINCT FROM f.sample), u AS (SELECT * FROM c UNION ALL SELECT * FROM a)
        SELECT contig, position, count(*) AS n, CAST(sum(record_id) AS BIGINT) AS ids, round(sum(ll), 5) AS ll FROM u GROUP BY ALL""",
    "likelihoods_per_read": f"WITH {_ROWS} SELECT contig, position, count(DISTINCT record_id) AS n FROM ml GROUP BY ALL",
    "diploid_alleles": f"WITH {_ROWS}, p AS (SELECT sample, contig, position, record_id, max(ll) FILTER (WHERE allele = ref_) AS a, max(ll) FILTER (WHERE allele <> ref_) AS b FROM (SELECT ml.*, s.ref AS ref_ FROM ml JOIN strands s USING (contig, position)) GROUP BY ALL) SELECT sample, contig, position, round(sum(a), 5) AS ll_ref, round(sum(log10((pow(10, a) + pow(10, b)) / 2)), 5) AS ll_het, round(sum(b), 5) AS ll_alt, count(*) AS n FROM p GROUP BY ALL",
}
