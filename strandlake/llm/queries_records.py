"""Queries on terms and duplicate records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import survivors, terms
from strandlake.queries.sqlparts import cigar_sum, contig_key
from strandlake.session import new_path
from strandlake.tables import table


def _p4_marked(spark: SparkSession, sf: str) -> DataFrame:
    counts = terms.TermCounts(spark)
    counts.apply(terms.list_deltas(table(spark, sf, "covariates"), "cov_values", "cov_values"), terms.row_deltas(table(spark, sf, "report_columns"), "column_name", ["report_id", "table_name"], "column_name"))
    return terms.marked_terms(counts.counts())


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p4_marked(spark, sf).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def p4_term_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _p4_marked(spark, sf)


def p4_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Counts that persist over three updates: all records as first delivered, then what a later state of the tables added, changed and deleted, then its deletion of one report.

    The later state: insertion events are withdrawn, deletion events have their values in lower case, and every report's columns come once more under the report's own name with ``.v2``.
    Only the differing records are read for the second update, and each update opens the folder anew.
    """
    path = new_path(spark, "term-counts")
    cov, columns = table(spark, sf, "covariates"), table(spark, sf, "report_columns")
    terms.TermCounts(spark, path).apply(terms.list_deltas(cov, "cov_values", "cov_values"), terms.row_deltas(columns, "column_name", ["report_id", "table_name"], "column_name"))
    values = F.when(F.col("event_type") == "D", F.transform("cov_values", lambda x: F.lower(x))).otherwise(F.col("cov_values"))
    later = cov.where(~F.col("event_type").eqNullSafe("I")).withColumn("cov_values", values)
    gone, new = terms.changed_records(cov.select("cov_id", "cov_values"), later.select("cov_id", "cov_values"), ["cov_id"], ["cov_values"])
    again = columns.withColumn("report_id", F.concat("report_id", F.lit(".v2"))).where("report_id is not null")
    terms.TermCounts(spark, path).apply(
        terms.list_deltas(gone, "cov_values", "cov_values", terms.REMOVED), terms.list_deltas(new, "cov_values", "cov_values"),
        terms.row_deltas(again, "column_name", ["report_id", "table_name"], "column_name"),
    )
    last = columns.agg(F.max("report_id")).head()[0]
    terms.TermCounts(spark, path).apply(terms.row_deltas(columns.where(F.col("report_id") == last), "column_name", ["report_id", "table_name"], "column_name", terms.REMOVED))
    return terms.marked_terms(terms.TermCounts(spark, path).counts())


def _read_tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [table(spark, sf, n) for n in ("reads", "read_groups", "contigs")]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return survivors.survivor_sources(*_read_tables(spark, sf)).select("group_id", "keep_id")


def p5_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return survivors.survivors(*_read_tables(spark, sf)).withColumn("attributes", F.array_join("attributes", ";"))


_TERMS = """
items AS (SELECT 'cov_values' AS field_name, CAST(cov_id AS VARCHAR) AS record, unnest(cov_values) AS term FROM covariates
    UNION ALL SELECT 'column_name', concat_ws('|', coalesce(report_id, 'null'), coalesce(table_name, 'null')), column_name FROM report_columns),
totals AS (SELECT 'cov_values' AS field_name, count(*) AS n FROM covariates
    UNION ALL SELECT 'column_name', count(*) FROM (SELECT DISTINCT report_id, table_name FROM report_columns)),
counted AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT record) AS records FROM items WHERE term <> '' GROUP BY ALL),
marked AS (SELECT counted.*, n FROM counted JOIN totals USING (field_name)),
flagged AS (SELECT field_name, term, occurrences, records, 'rare' AS mark FROM marked WHERE records <= 3
    UNION ALL SELECT field_name, term, occurrences, records, 'common' FROM marked WHERE records > n / 2.0)"""

#: The collection as the updates of ``p4_incremental`` leave it, counted at once.
_LATER = _TERMS.replace("unnest(cov_values) AS term FROM covariates", "unnest(CASE WHEN event_type = 'D' THEN list_transform(cov_values, lambda x: lower(x)) ELSE cov_values END) AS term FROM covariates WHERE event_type IS DISTINCT FROM 'I'").replace(
    "count(*) AS n FROM covariates", "count(*) AS n FROM covariates WHERE event_type IS DISTINCT FROM 'I'"
).replace("FROM report_columns", "FROM later_columns")
_LATER = f"later_columns AS (SELECT report_id, table_name, column_name FROM report_columns WHERE report_id IS DISTINCT FROM (SELECT max(report_id) FROM report_columns) UNION ALL SELECT report_id || '.v2', table_name, column_name FROM report_columns WHERE report_id IS NOT NULL), {_LATER}"

_GROUPS = f"""
ends AS (SELECT record_id, {cigar_sum("MIS=X")} AS rl, map_q, seq, base_quals, inferred_size, attributes, loaded_at, sample_name AS s, {contig_key("r.contig_name")} AS c, flag & 16 AS rev, CASE WHEN flag & 16 <> 0
        THEN contig_position + {cigar_sum("MDN=X")} - 1 + {cigar_sum("SH", r"regexp_extract(cigar, '[^0-9SH]((\d+[SH])+)$', 1)")}
        ELSE contig_position - {cigar_sum("SH", r"regexp_extract(cigar, '^((\d+[SH])+)', 1)")} END AS five,
    CASE WHEN mate_contig_name = '=' THEN {contig_key("r.contig_name")} ELSE {contig_key("mate_contig_name")} END AS m, mate_position
    FROM reads r JOIN read_groups USING (read_group) WHERE flag & 3332 = 0 AND contig_position >= 1 AND cigar <> '*' AND cigar <> ''),
keyed AS (SELECT *, CASE WHEN m IS NOT NULL THEN mate_position END AS mp,
    CASE WHEN map_q <> 255 THEN map_q END AS q,
    CAST(coalesce(map_q <> 255, FALSE) AS INT) + CAST(coalesce(seq NOT IN ('', '*'), FALSE) AS INT) + CAST(coalesce(base_quals NOT IN ('', '*'), FALSE) AS INT) + CAST(inferred_size IS NOT NULL AS INT) + CAST(coalesce(len(attributes), 0) > 0 AS INT) AS present FROM ends),
ranked AS (SELECT *, row_number() OVER g AS place, min(record_id) OVER k AS group_id, count(*) OVER k AS n FROM keyed
    WINDOW k AS (PARTITION BY s, c, rev, five, m, mp), g AS (PARTITION BY s, c, rev, five, m, mp ORDER BY present DESC, q DESC NULLS LAST, loaded_at DESC NULLS LAST, record_id))"""

#: The leader's fields; of each it lacks, the first in rank that has it. Bases and qualities must have the leader's length and come from one record.
_SURVIVORS = f"""
r AS (SELECT *, CASE WHEN seq NOT IN ('', '*') THEN length(seq) END AS ls, CASE WHEN base_quals NOT IN ('', '*') THEN length(base_quals) END AS lq, rl FROM ranked WHERE n > 1),
lead AS (SELECT s, c, rev, five, m, mp, record_id AS keep_id, ls AS ks, lq AS kq, rl AS kl FROM r WHERE place = 1),
cand AS (SELECT r.*, keep_id, ks, kq, kl, ks IS NULL AND ls = kl AND (kq IS NULL OR kq = kl) AS fs, kq IS NULL AND lq = coalesce(ks, kl) AS fq FROM r JOIN lead l ON r.s IS NOT DISTINCT FROM l.s AND r.c IS NOT DISTINCT FROM l.c AND r.rev = l.rev AND r.five = l.five
    AND r.m IS NOT DISTINCT FROM l.m AND r.mp IS NOT DISTINCT FROM l.mp),
survived0 AS (SELECT group_id, keep_id, n AS n_records, arg_min(q, place) FILTER (WHERE q IS NOT NULL) AS map_q, arg_min(inferred_size, place) FILTER (WHERE inferred_size IS NOT NULL) AS inferred_size,
    arg_min(array_to_string(attributes, ';'), place) FILTER (WHERE len(attributes) > 0) AS attributes, any_value(ks) AS ks, any_value(kq) AS kq,
    arg_min(seq, place) FILTER (WHERE place = 1) AS own_seq, arg_min(base_quals, place) FILTER (WHERE place = 1) AS own_quals,
    arg_min(seq, place) FILTER (WHERE fs AND fq) AS both_seq, arg_min(base_quals, place) FILTER (WHERE fs AND fq) AS both_quals,
    arg_min(seq, place) FILTER (WHERE fs) AS one_seq, min(place) FILTER (WHERE fs) AS seq_place, arg_min(base_quals, place) FILTER (WHERE fq) AS one_quals, min(place) FILTER (WHERE fq) AS quals_place
    FROM cand GROUP BY group_id, keep_id, n),
survived AS (SELECT group_id, keep_id, n_records, map_q, CASE WHEN ks IS NOT NULL THEN own_seq WHEN kq IS NOT NULL THEN one_seq WHEN both_seq IS NOT NULL THEN both_seq WHEN quals_place IS NULL OR seq_place < quals_place THEN one_seq END AS seq,
    CASE WHEN kq IS NOT NULL THEN own_quals WHEN ks IS NOT NULL THEN one_quals WHEN both_quals IS NOT NULL THEN both_quals WHEN seq_place IS NULL OR quals_place < seq_place THEN one_quals END AS base_quals, inferred_size, attributes FROM survived0)"""

QUERIES = {f.__name__: f for f in (p4_found, p4_term_counts, p4_incremental, p5_found, p5_survivors)}

ORACLES = {
    "p4_found": f"WITH {_TERMS} SELECT field_name, term, mark FROM flagged",
    "p4_term_counts": f"WITH {_TERMS} SELECT field_name, term, occurrences, records, mark FROM flagged UNION ALL SELECT field_name, term, occurrences, records, NULL FROM marked WHERE records > 3 AND NOT records > n / 2.0",
    "p4_incremental": f"WITH {_LATER} SELECT field_name, term, occurrences, records, mark FROM flagged UNION ALL SELECT field_name, term, occurrences, records, NULL FROM marked WHERE records > 3 AND NOT records > n / 2.0",
    "p5_survivors": f"WITH {_GROUPS}, {_SURVIVORS} SELECT * FROM survived",
    "p5_found": f"WITH {_GROUPS} SELECT group_id, record_id AS keep_id FROM ranked WHERE n > 1 AND place = 1",
}
