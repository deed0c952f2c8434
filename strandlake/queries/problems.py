"""Queries of the general data problems: rows that fail to parse, hot keys, overlapping intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import hotkeys, periods, rejects
from strandlake.queries.sqlparts import cigar_sum, contig_key, contigs
from strandlake.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_rejects(spark, sf).select("raw_table", "raw_id")


def p1_rejects(spark: SparkSession, sf: str) -> DataFrame:
    vcf = rejects.rejected(rejects.parse_vcf(table(spark, sf, "raw_vcf"), table(spark, sf, "contigs")))
    fastq = rejects.rejected(rejects.parse_fastq(table(spark, sf, "raw_fastq")))
    both = vcf.withColumn("raw_table", F.lit("raw_vcf")).unionByName(fastq.withColumn("raw_table", F.lit("raw_fastq")))
    return both.select("raw_table", "raw_id", "reason")


def p1_vcf_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = rejects.valid(rejects.parse_vcf(table(spark, sf, "raw_vcf"), table(spark, sf, "contigs")))
    return rows.withColumn("alts", F.array_join("alts", ","))


def p1_fastq_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.valid(rejects.parse_fastq(table(spark, sf, "raw_fastq")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return hotkeys.hot_keys(table(spark, sf, "variants"), table(spark, sf, "contigs"))


def _p2_stats(spark: SparkSession, sf: str, level: str) -> DataFrame:
    """The mean is rounded to six places in whole numbers: quals have at most six, so their sum in millionths is exact."""
    got = hotkeys.key_statistics(table(spark, sf, "variants"), table(spark, sf, "contigs")).where(F.col("key_level") == level)
    micro = F.round(F.col("qual_sum") * 1e6).cast("bigint")
    mean = F.when(F.col("qual_n") > 0, F.floor((2 * micro + F.col("qual_n")) / (2 * F.col("qual_n")).cast("decimal(38,0)")).cast("bigint") / 1e6)
    return got.withColumn("mean_qual", mean).drop("key_level", "qual_sum", "qual_n")


def p2_contig_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _p2_stats(spark, sf, "contig").drop("contig_position")


def p2_site_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _p2_stats(spark, sf, "site")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = periods.coverage_pieces(*(table(spark, sf, n) for n in ("reads", "read_groups", "gvcf_records", "contigs")))
    return pieces.select("track", "sample_name", "contig_name", "piece", "from_position", "to_position")


def p3_sample_coverage(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("to_position") - F.col("from_position") + 1
    is_period = F.col("piece") == "period"
    return p3_found(spark, sf).groupBy("track", "sample_name").agg(
        F.count_if(is_period).alias("periods"), F.coalesce(F.sum(F.when(is_period, size)), F.lit(0)).alias("covered"), F.coalesce(F.sum(F.when(~is_period, size)), F.lit(0)).alias("uncovered")
    )


_VCF_SQL = rf"""
raw AS (SELECT raw_id, line_text AS t FROM raw_vcf WHERE line_text IS NULL OR (line_text <> '' AND line_text NOT LIKE '#%')),
quoted AS (SELECT *, CASE WHEN t IS NULL THEN NULL WHEN NOT contains(t, '"') THEN TRUE
    ELSE regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') END AS sound FROM raw),
parts AS (SELECT *, CASE WHEN NOT sound THEN [] WHEN NOT contains(t, '"') THEN string_split(t, chr(9)) ELSE list_transform(regexp_extract_all(t || chr(9), '(?s)("(?:[^"]|"")*"|[^"\t]*)\t', 1),
    lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) END AS f FROM quoted),
known AS ({contigs()}),
named AS (SELECT parts.*, CASE WHEN regexp_replace(f[1], '^[cC][hH][rR]', '') = 'M' THEN 'MT' ELSE regexp_replace(f[1], '^[cC][hH][rR]', '') END AS bare FROM parts),
typed AS (SELECT named.*, cname, clen, string_split(f[5], ',') AS items FROM named LEFT JOIN known ON ckey = bare),
judged AS (SELECT *, CASE
    WHEN t IS NULL THEN 'null_text'
    WHEN NOT sound THEN 'quote'
    WHEN len(f) NOT IN (8, 10) THEN 'field_count'
    WHEN list_contains(f, '') THEN 'empty_field'
    WHEN cname IS NULL THEN 'contig'
    WHEN NOT regexp_full_match(f[2], '[0-9]+') OR coalesce(TRY_CAST(f[2] AS HUGEINT), 0) NOT BETWEEN 1 AND clen THEN 'position'
    WHEN NOT regexp_full_match(f[4], '[ACGTNacgtn]+') THEN 'ref'
    WHEN f[5] <> '.' AND len(list_filter(items, lambda x: NOT regexp_full_match(x, '[ACGTNacgtn]+|\*|<[A-Za-z][A-Za-z0-9_:]*>'))) > 0 THEN 'alt'
    WHEN f[5] <> '.' AND len(list_distinct(list_transform(list_append(items, f[4]), lambda x: upper(x)))) <= len(items) THEN 'alt_repeated'
    WHEN f[6] <> '.' AND NOT regexp_full_match(f[6], '[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') THEN 'qual'
    END AS reason FROM typed)"""

_FASTQ_SQL = r"""
lined AS (SELECT raw_id, record_text AS t, string_split(regexp_replace(CASE WHEN record_text LIKE '%' || chr(10) THEN left(record_text, length(record_text) - 1) || chr(0) ELSE record_text END, chr(13) || '(\n|\x00$)', '\1', 'g'), chr(10)) AS l0 FROM raw_fastq),
cut AS (SELECT raw_id, t, list_transform(l0, lambda x: CASE WHEN right(x, 1) = chr(0) AND right(t, 1) = chr(10) THEN left(x, length(x) - 1) ELSE x END) AS l FROM lined),
fq AS (SELECT *, CASE
    WHEN t IS NULL THEN 'null_text'
    WHEN len(l) <> 4 THEN 'line_count'
    WHEN NOT regexp_full_match(l[1], '(?s)@[^ \t].*') THEN 'description'
    WHEN NOT regexp_full_match(l[2], '[ACGTNacgtn]+') THEN 'sequence'
    WHEN l[3] <> '+' AND l[3] <> '+' || substr(l[1], 2) THEN 'separator'
    WHEN NOT regexp_full_match(l[4], '[!-~]+') THEN 'quality'
    WHEN length(l[4]) <> length(l[2]) THEN 'quality_length'
    END AS reason FROM cut)"""

_MEAN = "CASE WHEN count(qual) > 0 THEN ((2 * CAST(round(sum(qual) * 1000000) AS HUGEINT) + count(qual)) // (2 * count(qual))) / 1000000.0 END"
_KEYED = f"known AS ({contigs()}), v AS (SELECT variants.*, cname FROM (SELECT *, {contig_key()} AS k FROM variants) variants LEFT JOIN known ON ckey = k)"

_SPANS = f"""
known AS ({contigs()}),
reads_spans AS (SELECT 'reads' AS track, sample_name, cname, contig_position AS a, contig_position + {cigar_sum("MDN=X")} - 1 AS b
    FROM (SELECT *, {contig_key()} AS k FROM reads) r JOIN read_groups USING (read_group) JOIN known ON ckey = k
    WHERE flag & 4 = 0 AND contig_position >= 1 AND cigar <> '*' AND cigar <> ''),
gvcf_spans AS (SELECT 'gvcf' AS track, sample_name, cname, contig_position AS a,
    CASE WHEN e >= contig_position THEN e ELSE contig_position + length(ref_allele) - 1 END AS b
    FROM (SELECT *, {contig_key()} AS k, TRY_CAST(regexp_extract(info, '(^|;)END=([0-9]+)(;|$)', 2) AS BIGINT) AS e FROM gvcf_records) g JOIN known ON ckey = k),
spans AS (SELECT * FROM reads_spans UNION SELECT * FROM gvcf_spans),
before AS (SELECT *, max(b) OVER (PARTITION BY track, sample_name, cname ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM spans WHERE b >= a),
islands AS (SELECT *, sum(CASE WHEN pb IS NULL OR a > pb + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY track, sample_name, cname ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM before),
covered AS (SELECT track, sample_name, cname, island, min(a) AS a, max(b) AS b FROM islands GROUP BY ALL),
gaps AS (SELECT track, sample_name, cname, b + 1 AS a, lead(a) OVER (PARTITION BY track, sample_name, cname ORDER BY a) - 1 AS b FROM covered),
pieces AS (SELECT track, sample_name, cname AS contig_name, 'period' AS piece, CAST(a AS BIGINT) AS from_position, CAST(b AS BIGINT) AS to_position FROM covered
    UNION ALL SELECT track, sample_name, cname, 'gap', CAST(a AS BIGINT), CAST(b AS BIGINT) FROM gaps WHERE b IS NOT NULL)"""

QUERIES = {f.__name__: f for f in (p1_found, p1_rejects, p1_vcf_rows, p1_fastq_rows, p2_found, p2_contig_stats, p2_site_stats, p3_found, p3_sample_coverage)}

ORACLES = {
    "p1_rejects": f"WITH {_VCF_SQL}, {_FASTQ_SQL} SELECT 'raw_vcf' AS raw_table, raw_id, reason FROM judged WHERE reason IS NOT NULL UNION ALL SELECT 'raw_fastq', raw_id, reason FROM fq WHERE reason IS NOT NULL",
    "p1_found": f"WITH {_VCF_SQL}, {_FASTQ_SQL} SELECT 'raw_vcf' AS raw_table, raw_id FROM judged WHERE reason IS NOT NULL UNION ALL SELECT 'raw_fastq', raw_id FROM fq WHERE reason IS NOT NULL",
    "p1_vcf_rows": f"""WITH {_VCF_SQL} SELECT raw_id, cname AS contig_name, CAST(f[2] AS BIGINT) AS contig_position, f[3] AS variant_id, f[4] AS ref_allele, CASE WHEN f[5] = '.' THEN '' ELSE f[5] END AS alts,
        TRY_CAST(f[6] AS DOUBLE) AS qual, f[7] AS filters, f[8] AS info, f[9] AS format_keys, f[10] AS genotype FROM judged WHERE reason IS NULL""",
    "p1_fastq_rows": f"""WITH {_FASTQ_SQL} SELECT raw_id, substr(l[1], 2) AS description, regexp_replace(regexp_extract(l[1], '(?s)^@([^ ]*)', 1), '/[12]$', '') AS read_name, l[2] AS seq, l[4] AS base_quals FROM fq WHERE reason IS NULL""",
    "p2_found": f"""WITH {_KEYED} SELECT 'contig' AS key_level, cname AS contig_name, CAST(0 AS BIGINT) AS contig_position FROM v WHERE cname IS NOT NULL GROUP BY cname HAVING count(*) > 0.08 * (SELECT count(*) FROM v)
        UNION ALL SELECT 'site', cname, CAST(contig_position AS BIGINT) FROM v WHERE cname IS NOT NULL GROUP BY cname, contig_position HAVING count(*) > 0.02 * (SELECT count(*) FROM v)""",
    "p2_contig_stats": f"WITH {_KEYED} SELECT cname AS contig_name, count(*) AS n_rows, {_MEAN} AS mean_qual, count(DISTINCT sample_name) AS n_samples FROM v GROUP BY cname",
    "p2_site_stats": f"WITH {_KEYED} SELECT cname AS contig_name, CAST(contig_position AS BIGINT) AS contig_position, count(*) AS n_rows, {_MEAN} AS mean_qual, count(DISTINCT sample_name) AS n_samples FROM v GROUP BY ALL",
    "p3_found": f"WITH {_SPANS} SELECT * FROM pieces",
    "p3_sample_coverage": f"""WITH {_SPANS} SELECT track, sample_name, count(*) FILTER (WHERE piece = 'period') AS periods, CAST(coalesce(sum(to_position - from_position + 1) FILTER (WHERE piece = 'period'), 0) AS BIGINT) AS covered,
        CAST(coalesce(sum(to_position - from_position + 1) FILTER (WHERE piece = 'gap'), 0) AS BIGINT) AS uncovered FROM pieces GROUP BY track, sample_name""",
}
