"""Queries through text formats, the plan and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import rejects
from strandlake.plans.germline import germline
from strandlake.queries.genome import _DEDUP
from strandlake.queries.problems import _FASTQ_SQL
from strandlake.queries.sqlparts import contig_key, contigs
from strandlake.session import new_path, staged
from strandlake.sources import fastq, sinks, text
from strandlake.streaming import streams
from strandlake.tables import table


def sam_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "reads").select("record_id", sinks.sam_line().alias("line"))


def sam_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Reads written as sorted SAM text and read again."""
    path, contigs = new_path(spark, "sam"), table(spark, sf, "contigs")
    sinks.write_sorted(table(spark, sf, "reads"), contigs, sinks.sam_line(), sinks.sam_header_lines(contigs, table(spark, sf, "read_groups")), path)
    back = text.read_sam(spark, path, contigs)
    return back.select("read_name", "flag", "contig_name", "contig_position", "map_q", "cigar", "mate_position", "inferred_size", "seq", "base_quals", F.size("attributes").alias("n_tags"))


def vcf_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "variants").select("record_id", sinks.vcf_line().alias("line"))


def vcf_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Calls written as sorted VCF text and read again by the strict parser."""
    path, contigs = new_path(spark, "vcf"), table(spark, sf, "contigs")
    calls = table(spark, sf, "variants").withColumn("contig_name", F.trim("contig_name"))
    sinks.write_sorted(calls, contigs, sinks.vcf_line(), sinks.vcf_header_lines(contigs, ["sample"]), path)
    valid, _ = text.read_vcf(spark, path, contigs)
    return valid.groupBy("contig_name").agg(F.count(F.lit(1)).alias("n"), F.sum("contig_position").alias("positions"), F.count("qual").alias("with_qual"))


def fastq_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Valid FASTQ records written as text and read by the splitting source, in splits much smaller than its files."""
    path = new_path(spark, "fastq")
    rejects.valid(rejects.parse_fastq(table(spark, sf, "raw_fastq"))).select(sinks.fastq_text()).write.text(path)
    fastq.register(spark)
    return spark.read.format("strand_fastq").option("split_bytes", 16384).load(path)


def fastq_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All FASTQ texts written one below the other and read again as records of four lines, in splits much smaller than the files: how many of each reason."""
    path = new_path(spark, "fastq-scan")
    texts = table(spark, sf, "raw_fastq").where("record_text is not null").select(F.regexp_replace("record_text", "\r?\n$", "").alias("value"))
    texts.where(F.size(F.split("value", "\n")) == 4).write.text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
    try:
        good, bad = text.read_fastq(spark, path)
        got = good.select(F.lit("valid").alias("reason"), F.length("seq").alias("bases")).unionByName(bad.select("reason", F.lit(0).alias("bases")))
        return staged(got.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("bases").alias("bases")), "fastq-scan")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def events_windows(spark: SparkSession, sf: str) -> DataFrame:
    return streams.windowed_counts(table(spark, sf, "events"), "ts", ["event_type"])


def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return streams.sessions(table(spark, sf, "events"), "ts", ["user_id"], gap="6 hours")


def germline_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of the whole germline plan."""
    plan = germline(spark, {n: table(spark, sf, n) for n in ("reads", "read_groups", "contigs", "variants")})
    return plan.result("calls")


def germline_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Reads, bases and sound quality texts that come out of each stage of the germline plan that changes reads; none may lose or gain a read or a base."""
    tables = germline(spark, {n: table(spark, sf, n) for n in ("reads", "read_groups", "contigs", "variants")}).run(until="recalibrated_reads")
    per = []
    for name in ("unique_reads", "realigned_reads", "recalibrated_reads"):
        sound = F.count_if((F.length("base_quals") == F.length("seq")) & ~F.col("base_quals").isin("", "*"))
        rows = tables[name].agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.length("seq")).alias("n_bases"), F.sum("record_id").alias("ids"), sound.alias("with_quals"))
        per.append(rows.withColumn("stage", F.lit(name)))
    return per[0].unionByName(per[1]).unionByName(per[2]).select("stage", "n_reads", "n_bases", "ids", "with_quals")


def stage_topology(spark: SparkSession, sf: str) -> DataFrame:
    """The order of the germline plan's stages and the chains it can run as one."""
    plan = germline(spark, {n: table(spark, sf, n) for n in ("reads", "read_groups", "contigs", "variants")})
    chain = {s: i for i, c in enumerate(plan.chains()) for s in c}
    return spark.createDataFrame([(i, s, chain.get(s)) for i, s in enumerate(plan.order())], "place int, stage string, chain int")


def _star(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN '*' ELSE {c} END"


_MATE = f"CASE WHEN mate_contig_name = '=' THEN '=' WHEN ({contig_key('mate_contig_name')}) = ({contig_key('contig_name')}) THEN '=' ELSE {_star('mate_contig_name')} END"
_QUAL = "CASE WHEN qual IS NULL THEN '.' ELSE regexp_replace(printf('%.2f', qual), '\\.00$', '') END"

QUERIES = {f.__name__: f for f in (sam_lines, sam_round_trip, vcf_lines, vcf_round_trip, fastq_round_trip, fastq_scan, events_windows, events_sessions, germline_plan, germline_reads, stage_topology)}

_STAGES = " UNION ALL ".join(f"SELECT '{x}' AS stage" for x in ("unique_reads", "realigned_reads", "recalibrated_reads"))

ORACLES = {
    "germline_reads": f"""WITH {_DEDUP}, u AS (SELECT count(*) AS n_reads, CAST(sum(length(seq)) AS BIGINT) AS n_bases, CAST(sum(record_id) AS BIGINT) AS ids, count(*) FILTER (WHERE length(seq) = length(base_quals) AND base_quals NOT IN ('', '*')) AS with_quals FROM reads SEMI JOIN finally USING (record_id))
        SELECT stage, n_reads, n_bases, ids, with_quals FROM u, ({_STAGES})""",
    "sam_lines": f"""SELECT record_id, concat_ws(chr(9), {_star('read_name')}, coalesce(flag, 0), {_star('contig_name')}, coalesce(contig_position, 0), coalesce(map_q, 255), {_star('cigar')}, {_MATE}, coalesce(mate_position, 0), coalesce(inferred_size, 0), {_star('seq')}, {_star('base_quals')},
        CASE WHEN len(attributes) > 0 THEN array_to_string(attributes, chr(9)) END) AS line FROM reads""",
    "sam_round_trip": f"SELECT {_star('read_name')} AS read_name, coalesce(flag, 0) AS flag, {_star('contig_name')} AS contig_name, coalesce(contig_position, 0) AS contig_position, coalesce(map_q, 255) AS map_q, {_star('cigar')} AS cigar, coalesce(mate_position, 0) AS mate_position, coalesce(inferred_size, 0) AS inferred_size, {_star('seq')} AS seq, {_star('base_quals')} AS base_quals, CAST(coalesce(len(attributes), 0) AS INT) AS n_tags FROM reads",
    "vcf_round_trip": f"""WITH v AS (SELECT trim(contig_name) AS c, contig_position AS p, {_QUAL} AS q, ref_allele, alt, variant_id, filters, rest FROM variants), k AS (SELECT *, CASE WHEN regexp_replace(c, '^[cC][hH][rR]', '') = 'M' THEN 'MT' ELSE regexp_replace(c, '^[cC][hH][rR]', '') END AS b FROM v),
        j AS (SELECT cname, p, q FROM k JOIN ({contigs()}) ON ckey = b WHERE p BETWEEN 1 AND clen AND regexp_full_match(ref_allele, '[ACGTNacgtn]+') AND (alt = '.' OR (len(list_filter(string_split(alt, ','), lambda x: NOT regexp_full_match(x, '[ACGTNacgtn]+|[*]|<[A-Za-z][A-Za-z0-9_:]*>'))) = 0
            AND len(list_distinct(list_transform(list_append(string_split(alt, ','), ref_allele), lambda x: upper(x)))) > len(string_split(alt, ',')))) AND (q = '.' OR regexp_full_match(q, '[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?')) AND len(string_split(rest, chr(9))) IN (1, 3) AND NOT list_contains(string_split(rest, chr(9)), '')
            AND NOT contains(rest, '"'))
        SELECT cname AS contig_name, count(*) AS n, CAST(sum(p) AS BIGINT) AS positions, count(*) FILTER (WHERE q <> '.') AS with_qual FROM j GROUP BY cname""",
    "fastq_round_trip": rf"""WITH {_FASTQ_SQL} SELECT substr(l[1], 2) AS description, regexp_replace(regexp_extract(l[1], '(?s)^@([^ ]*)', 1), '/[12]$', '') AS read_name, l[2] AS seq, l[4] AS base_quals FROM fq WHERE reason IS NULL""",
    "fastq_scan": r"""WITH t AS (SELECT regexp_replace(record_text, '\r?\n$', '') AS x FROM raw_fastq WHERE record_text IS NOT NULL), l AS (SELECT list_transform(string_split(x, chr(10)), lambda y: regexp_replace(y, '\r$', '')) AS l FROM t WHERE len(string_split(x, chr(10))) = 4), r AS (SELECT l, CASE WHEN NOT regexp_full_match(l[1], '(?s)@[^ \t].*') THEN 'description'
        WHEN NOT regexp_full_match(l[2], '[ACGTNacgtn]+') THEN 'sequence' WHEN l[3] <> '+' AND l[3] <> '+' || substr(l[1], 2) THEN 'separator' WHEN NOT regexp_full_match(l[4], '[!-~]+') THEN 'quality' WHEN length(l[4]) <> length(l[2]) THEN 'quality_length' ELSE 'valid' END AS reason FROM l)
        SELECT reason, count(*) AS n, CAST(sum(CASE WHEN reason = 'valid' THEN length(l[2]) ELSE 0 END) AS BIGINT) AS bases FROM r GROUP BY reason""",
    "vcf_lines": f"SELECT record_id, concat_ws(chr(9), contig_name, contig_position, variant_id, ref_allele, alt, {_QUAL}, filters, rest) AS line FROM variants",
    "events_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "events_sessions": """WITH p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS pt FROM events), i AS (SELECT *, sum(CASE WHEN pt IS NULL OR ts > pt + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM p)
        SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, user_id, count(*) AS n FROM i GROUP BY user_id, s""",
}
