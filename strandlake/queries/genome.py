"""Queries on bins, read filters, intervals and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import bins, dedup, filters, intervals, periods
from strandlake.queries.sqlparts import cigar_sum, contig_key, contigs
from strandlake.tables import table, with_contig

_BIN = bins.BIN_LENGTH


def bin_table(spark: SparkSession, sf: str) -> DataFrame:
    return bins.bin_table(table(spark, sf, "contigs"))


def bin_table_overlap(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "contigs")
    return bins.with_overlap(bins.bin_table(c), c)


def bin_of_position(spark: SparkSession, sf: str) -> DataFrame:
    return bins.with_bin(table(spark, sf, "reads"), table(spark, sf, "contigs")).select("record_id", "bin_id", "bin_start", "bin_end")


def bin_read_counts(spark: SparkSession, sf: str) -> DataFrame:
    return bins.bin_counts(bins.with_bin(table(spark, sf, "reads"), table(spark, sf, "contigs")))


def skewed_bins(spark: SparkSession, sf: str) -> DataFrame:
    return bins.skewed_bins(bins.bin_counts(bins.with_bin(table(spark, sf, "variants"), table(spark, sf, "contigs"))), factor=bins.SKEW_FACTOR)


def bin_overlap_reads(spark: SparkSession, sf: str) -> DataFrame:
    return bins.with_replicas(table(spark, sf, "reads"), table(spark, sf, "contigs")).select("record_id", "bin_id", "is_owner")


def bin_overlap_variants(spark: SparkSession, sf: str) -> DataFrame:
    return bins.with_replicas(table(spark, sf, "variants"), table(spark, sf, "contigs"), strict=True).select("record_id", "bin_id", "is_owner")


def filter_counts(spark: SparkSession, sf: str) -> DataFrame:
    reads = table(spark, sf, "reads")
    return reads.agg(*(F.count_if(filters.removed_by(n)).alias(n) for n in filters.FILTERS))


def filter_chains(spark: SparkSession, sf: str) -> DataFrame:
    reads = table(spark, sf, "reads")
    return reads.agg(*(F.count_if(filters.keep(names)).alias(preset) for preset, names in filters.PRESETS.items()))


def recalibrator_reads(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filtered(table(spark, sf, "reads"), "recalibrator").select("record_id", "flag", "map_q")


def _tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [table(spark, sf, n) for n in ("reads", "read_groups", "contigs")]


def dedup_best(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.deduplicated(*_tables(spark, sf), mate_unmapped_rule=False).select("record_id")


def dedup_mate_unmapped_rule(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.deduplicated(*_tables(spark, sf)).select("record_id")


def dedup_flagged(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.flagged(*_tables(spark, sf)).select("record_id", "flag")


def dedup_bin_counts(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedup.deduplicated(*_tables(spark, sf), mate_unmapped_rule=False)
    binned = bins.with_bin(kept, table(spark, sf, "contigs")).where("bin_id is not null")
    return binned.groupBy("bin_id").agg(F.count(F.lit(1)).alias("n_reads"), F.sum("map_q").alias("sum_map_q"))


_KEYS, _PLACE = ["sample_name", "contig_name"], ["contig_name"]


def _read_spans(spark: SparkSession, sf: str) -> DataFrame:
    return periods.read_spans(*_tables(spark, sf))


def _gvcf_spans(spark: SparkSession, sf: str) -> DataFrame:
    return periods.gvcf_spans(table(spark, sf, "gvcf_records"), table(spark, sf, "contigs"))


def range_join_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """How many reads each GVCF record overlaps, of all samples."""
    blocks = table(spark, sf, "gvcf_records")
    named = blocks.select("record_id", "sample_name", "contig_name", "contig_position", "info", "ref_allele")
    spans = with_contig(named, table(spark, sf, "contigs"), out="c").where("c is not null").select("record_id", "sample_name", F.col("c").alias("contig_name"), F.col("contig_position").cast("bigint").alias("a"), periods.gvcf_end().cast("bigint").alias("b"))
    pairs = intervals.range_join(spans, _read_spans(spark, sf), _PLACE, "a", "b", "from_position", "to_position")
    return pairs.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_reads"), F.sum(intervals.overlap_size(F.col("a"), F.col("b"), F.col("from_position"), F.col("to_position"))).alias("shared_positions"))


def panel_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct read spans that overlap a GVCF record."""
    return intervals.range_join(_read_spans(spark, sf).distinct(), _gvcf_spans(spark, sf).distinct(), _PLACE, "from_position", "to_position", "from_position", "to_position", how="left_semi")


def panel_anti(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.range_join(_read_spans(spark, sf).distinct(), _gvcf_spans(spark, sf).distinct(), _PLACE, "from_position", "to_position", "from_position", "to_position", how="left_anti")


def interval_merge_all(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merged(_gvcf_spans(spark, sf), _KEYS, "from_position", "to_position")


def interval_merge_overlapping(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merged(_gvcf_spans(spark, sf), _KEYS, "from_position", "to_position", abutting=False)


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return tuple(intervals.merged(s, _PLACE, "from_position", "to_position") for s in (_read_spans(spark, sf), _gvcf_spans(spark, sf)))


def interval_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.intersected(*_both(spark, sf), _PLACE)


def interval_subtract(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.subtracted(*_both(spark, sf), _PLACE)


def interval_union(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merged(_read_spans(spark, sf).unionByName(_gvcf_spans(spark, sf)), _KEYS, "from_position", "to_position")


def covered_size(spark: SparkSession, sf: str) -> DataFrame:
    return interval_union(spark, sf).groupBy(*_KEYS).agg(F.sum(F.col("to_position") - F.col("from_position") + 1).alias("covered"))


def coverage_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Positions by depth, per sample."""
    runs = intervals.depth_runs(_read_spans(spark, sf), _KEYS, "from_position", "to_position")
    return runs.groupBy("sample_name", "depth").agg(F.sum(F.col("to_position") - F.col("from_position") + 1).alias("n_positions"))


def loc_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of each GVCF record with a window of 100 positions around the next multiple of 1000."""
    spans = _gvcf_spans(spark, sf).distinct()
    a1, a2 = F.col("from_position"), F.col("to_position")
    w = F.expr("((from_position div 1000) + 1) * 1000").cast("bigint")
    b1, b2 = w - 50, w + 49
    return spans.select(
        "sample_name", "contig_name", "from_position", "to_position", intervals.overlap_size(a1, a2, b1, b2).alias("shared"), intervals.distance(a1, a2, b1, b2).alias("distance"), intervals.contiguous(a1, a2, b1, b2).alias("contiguous"),
        intervals.contains(a1, a2, b1, b2).alias("contains"), F.round(intervals.reciprocal_overlap(a1, a2, b1, b2), 6).alias("reciprocal"), F.size(intervals.minus(a1, a2, b1, b2)).alias("pieces_left"),
        F.coalesce(F.aggregate(intervals.minus(a1, a2, b1, b2), F.lit(0).cast("bigint"), lambda s, p: s + p["to_position"] - p["from_position"] + 1), F.lit(0)).alias("size_left"),
    )


def loc_parse(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "gvcf_records")
    text = F.concat(F.col("contig_name"), F.lit(":"), F.format_number("contig_position", 0), F.when(F.col("record_id") % 3 == 0, "").when(F.col("record_id") % 3 == 1, "+").otherwise(F.concat(F.lit("-"), F.col("contig_position") + 10)))
    return g.select("record_id", intervals.parse_location(text).alias("p")).select("record_id", "p.contig", "p.from_position", "p.to_position")


_PLACED = f"""known AS ({contigs()}),
placed AS (SELECT r.*, cid, cname, clen FROM (SELECT *, {contig_key()} AS k FROM reads) r LEFT JOIN known ON ckey = k)"""
_BINS = f"""offs AS (SELECT contig_id, contig_name, contig_length, (contig_length + {_BIN - 1}) // {_BIN} AS n_bins FROM contigs),
firsts AS (SELECT *, CAST(coalesce(sum(n_bins) OVER (ORDER BY contig_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_bin FROM offs),
bin_rows AS (SELECT first_bin + i AS bin_id, contig_id, contig_name, contig_length, CAST(i * {_BIN} + 1 AS BIGINT) AS start_position, CAST(least((i + 1) * {_BIN}, contig_length) AS BIGINT) AS end_position
    FROM (SELECT *, unnest(range(CAST(n_bins AS BIGINT))) AS i FROM firsts))"""
_BINNED = f"""{_BINS}, {_PLACED},
binned AS (SELECT placed.*, CASE WHEN contig_position BETWEEN 1 AND contig_length THEN first_bin + (contig_position - 1) // {_BIN} END AS bin_id,
    CASE WHEN contig_position BETWEEN 1 AND contig_length THEN CAST((contig_position - 1) // {_BIN} * {_BIN} + 1 AS BIGINT) END AS bin_start,
    CASE WHEN contig_position BETWEEN 1 AND contig_length THEN CAST(least(((contig_position - 1) // {_BIN} + 1) * {_BIN}, contig_length) AS BIGINT) END AS bin_end, contig_length
    FROM placed LEFT JOIN firsts ON firsts.contig_id = placed.cid)"""


def _replicas(source: str, back: str, forth: str) -> str:
    return f"""WITH {_BINNED.replace("FROM reads", f"FROM {source}")}
    SELECT record_id, unnest(list_filter([bin_id, CASE WHEN bin_start > 1 AND contig_position {back} bin_start + {bins.BIN_OVERLAP} THEN bin_id - 1 END, CASE WHEN bin_end < contig_length AND contig_position {forth} bin_end - {bins.BIN_OVERLAP} THEN bin_id + 1 END], lambda x: x IS NOT NULL)) AS bin_id_,
        bin_id AS own FROM binned WHERE bin_id IS NOT NULL"""


_FILTER_SQL = {
    "unmapped": "flag & 4 <> 0 OR contig_position < 1",
    "not_primary": "flag & 256 <> 0",
    "supplementary": "flag & 2048 <> 0",
    "duplicate": "flag & 1024 <> 0",
    "vendor_fail": "flag & 512 <> 0",
    "mapq_zero": "map_q = 0",
    "mapq_unavailable": "map_q = 255",
    "mapq_below_20": "map_q < 20",
    "bad_mate": f"flag & 1 <> 0 AND flag & 8 = 0 AND flag & 4 = 0 AND trim(mate_contig_name) <> '=' AND ({contig_key('mate_contig_name')}) <> ({contig_key()})",
    "bad_cigar": r"cigar <> '*' AND cigar <> '' AND (NOT regexp_matches(cigar, '^(\d+H)?(\d+S)?(\d+[MIDNP=X])+(\d+S)?(\d+H)?$') OR regexp_matches(cigar, '\d+[ID]\d+[ID]') OR regexp_matches(cigar, '^(\d+[HS])*\d+D') OR regexp_matches(cigar, '\d+D(\d+[HS])*$') OR NOT regexp_matches(cigar, '[M=X]'))",
    "negative_start": r"contig_position <= 0 OR contig_position - coalesce(TRY_CAST(regexp_extract(cigar, '^(?:\d+H)?(\d+)S', 1) AS INT), 0) <= 0",
    "heavy_soft_clip": f"{cigar_sum('MIDNSHP=X')} > 0 AND {cigar_sum('S')} / {cigar_sum('MIDNSHP=X')} >= 0.30",
    "insert_too_big": "abs(inferred_size) > 3000",
    "short_read": "length(seq) < 10",
    "no_read_group": "read_group IS NULL",
    "mate_rescued": "list_contains(attributes, 'XT:A:M')",
    "not_in_duplicate_stage": "flag & 3332 <> 0",
}


def _kept(names: tuple[str, ...]) -> str:
    return "NOT (" + " OR ".join(f"coalesce({_FILTER_SQL[n]}, FALSE)" for n in names) + ")"


_DEDUP = f"""known AS ({contigs()}),
votes AS (SELECT r.*, sample_name AS s, o.cid AS c, flag & 16 <> 0 AS rev, regexp_replace(read_name, '/[12]$', '') AS fname,
    CASE WHEN flag & 1 <> 0 AND flag & 8 = 0 AND m.cid IS NOT NULL AND mate_position >= 1 THEN ROW(m.cid, CAST(mate_position AS BIGINT), flag & 32 <> 0) END AS mate_end
    FROM (SELECT *, {contig_key()} AS k, CASE WHEN trim(mate_contig_name) = '=' THEN {contig_key()} ELSE {contig_key("mate_contig_name")} END AS mk FROM reads) r
    JOIN known o ON o.ckey = k LEFT JOIN known m ON m.ckey = mk LEFT JOIN read_groups USING (read_group) WHERE flag & 3332 = 0 AND contig_position >= 1),
fragments AS (SELECT s, fname, min(ROW(c, CAST(contig_position AS BIGINT), rev)) AS a, max(ROW(c, CAST(contig_position AS BIGINT), rev)) AS b, max(mate_end) AS m, count(*) AS n, sum(coalesce(map_q, 0)) AS score FROM votes GROUP BY s, fname),
fkeys AS (SELECT s, fname, score, CASE WHEN n = 1 AND m IS NOT NULL THEN least(a, m) ELSE a END AS k1, CASE WHEN n = 1 AND m IS NOT NULL THEN greatest(a, m) WHEN n > 1 THEN b END AS k2 FROM fragments),
winners AS (SELECT s, fname FROM (SELECT *, row_number() OVER (PARTITION BY s, k1, k2 ORDER BY score DESC, fname) AS place FROM fkeys) WHERE place = 1),
kept AS (SELECT v.* FROM votes v JOIN winners w ON v.fname = w.fname AND v.s IS NOT DISTINCT FROM w.s),
ruled AS (SELECT kept.*, max(CASE WHEN flag & 8 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY s, c, contig_position) AS any8 FROM kept),
finally AS (SELECT * FROM ruled WHERE any8 = 0 OR flag & 8 <> 0)"""

_SPANS = f"""known AS ({contigs()}),
rs AS (SELECT sample_name, cname AS contig_name, CAST(contig_position AS BIGINT) AS a, contig_position + {cigar_sum("MDN=X")} - 1 AS b FROM (SELECT *, {contig_key()} AS k FROM reads) r JOIN read_groups USING (read_group) JOIN known ON ckey = k
    WHERE flag & 4 = 0 AND contig_position >= 1 AND cigar <> '*' AND cigar <> ''),
gs AS (SELECT record_id, sample_name, cname AS contig_name, CAST(contig_position AS BIGINT) AS a, CASE WHEN e >= contig_position THEN e ELSE contig_position + length(ref_allele) - 1 END AS b
    FROM (SELECT *, {contig_key()} AS k, TRY_CAST(regexp_extract(info, '(^|;)END=([0-9]+)(;|$)', 2) AS BIGINT) AS e FROM gvcf_records) g JOIN known ON ckey = k)"""


def _merge_sql(name: str, source: str, slack: int, keys: str = "sample_name, contig_name") -> str:
    return f"""{name}_b AS (SELECT *, max(b) OVER (PARTITION BY {keys} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM (SELECT DISTINCT {keys}, a, b FROM {source}) WHERE b >= a),
{name}_i AS (SELECT *, sum(CASE WHEN pb IS NULL OR a > pb + {slack} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM {name}_b),
{name} AS (SELECT {keys}, CAST(min(a) AS BIGINT) AS a, CAST(max(b) AS BIGINT) AS b FROM {name}_i GROUP BY {keys}, isl)"""


_OUT = "sample_name, contig_name, a AS from_position, b AS to_position"
_MERGED = f"{_SPANS}, {_merge_sql('rm', 'rs', 1)}, {_merge_sql('gm', 'gs', 1)}"
_TRACKS = f"{_SPANS}, {_merge_sql('rm', 'rs', 1, 'contig_name')}, {_merge_sql('gm', 'gs', 1, 'contig_name')}"
_W = "((a // 1000) + 1) * 1000"

QUERIES = {
    f.__name__: f
    for f in (
        bin_table, bin_table_overlap, bin_of_position, bin_read_counts, skewed_bins, bin_overlap_reads, bin_overlap_variants, filter_counts, filter_chains, recalibrator_reads, dedup_best, dedup_mate_unmapped_rule, dedup_flagged,
        dedup_bin_counts, range_join_overlap, panel_semi, panel_anti, interval_merge_all, interval_merge_overlapping, interval_intersect, interval_subtract, interval_union, covered_size, coverage_depth, loc_relations, loc_parse,
    )
}

ORACLES = {
    "bin_table": f"WITH {_BINS} SELECT bin_id, contig_id, contig_name, start_position, end_position FROM bin_rows",
    "bin_table_overlap": f"WITH {_BINS} SELECT bin_id, contig_id, contig_name, CAST(greatest(1, start_position - 3000) AS BIGINT) AS start_position, CAST(least(end_position + 3000, contig_length) AS BIGINT) AS end_position FROM bin_rows",
    "bin_of_position": f"WITH {_BINNED} SELECT record_id, bin_id, bin_start, bin_end FROM binned",
    "bin_read_counts": f"WITH {_BINNED} SELECT bin_id, count(*) AS n_reads FROM binned WHERE bin_id IS NOT NULL GROUP BY bin_id",
    "skewed_bins": f"WITH {_BINNED.replace('FROM reads', 'FROM variants')}, n AS (SELECT bin_id, count(*) AS n_reads FROM binned WHERE bin_id IS NOT NULL GROUP BY bin_id), m AS (SELECT CAST(floor(sum(n_reads) / count(*)) AS BIGINT) AS mean_reads FROM n) SELECT bin_id, n_reads, mean_reads FROM n, m WHERE n_reads > 4 * mean_reads",
    "bin_overlap_reads": f"SELECT record_id, bin_id_ AS bin_id, bin_id_ = own AS is_owner FROM ({_replicas('reads', '<=', '>=')})",
    "bin_overlap_variants": f"SELECT record_id, bin_id_ AS bin_id, bin_id_ = own AS is_owner FROM ({_replicas('variants', '<', '>')})",
    "filter_counts": "SELECT " + ", ".join(f"count(*) FILTER (WHERE {sql}) AS {n}" for n, sql in _FILTER_SQL.items()) + " FROM reads",
    "filter_chains": "SELECT " + ", ".join(f"count(*) FILTER (WHERE {_kept(names)}) AS {p}" for p, names in filters.PRESETS.items()) + " FROM reads",
    "recalibrator_reads": f"SELECT record_id, flag, map_q FROM reads WHERE {_kept(filters.PRESETS['recalibrator'])}",
    "dedup_best": f"WITH {_DEDUP} SELECT record_id FROM kept",
    "dedup_mate_unmapped_rule": f"WITH {_DEDUP} SELECT record_id FROM finally",
    "dedup_flagged": f"WITH {_DEDUP} SELECT r.record_id, CASE WHEN flag & 3332 = 0 AND k.record_id IS NULL AND contig_position >= 1 THEN flag | 1024 ELSE flag END AS flag FROM reads r LEFT JOIN (SELECT record_id FROM finally) k ON r.record_id = k.record_id",
    "dedup_bin_counts": f"WITH {_DEDUP}, {_BINS} SELECT first_bin + (contig_position - 1) // {_BIN} AS bin_id, count(*) AS n_reads, CAST(sum(map_q) AS BIGINT) AS sum_map_q FROM kept JOIN firsts ON kept.c = firsts.contig_id WHERE contig_position <= contig_length GROUP BY 1",
    "range_join_overlap": f"WITH {_SPANS} SELECT record_id, count(*) AS n_reads, CAST(sum(least(g.b, r.b) - greatest(g.a, r.a) + 1) AS BIGINT) AS shared_positions FROM gs g JOIN rs r ON g.contig_name = r.contig_name AND g.a <= r.b AND r.a <= g.b GROUP BY record_id",
    "panel_semi": f"WITH {_SPANS} SELECT DISTINCT {_OUT} FROM rs r WHERE b >= a AND EXISTS (SELECT 1 FROM gs g WHERE g.contig_name = r.contig_name AND g.a <= r.b AND r.a <= g.b)",
    "panel_anti": f"WITH {_SPANS} SELECT DISTINCT {_OUT} FROM rs r WHERE NOT EXISTS (SELECT 1 FROM gs g WHERE g.contig_name = r.contig_name AND g.a <= r.b AND r.a <= g.b)",
    "interval_merge_all": f"WITH {_MERGED} SELECT {_OUT} FROM gm",
    "interval_merge_overlapping": f"WITH {_SPANS}, {_merge_sql('gm', 'gs', 0)} SELECT {_OUT} FROM gm",
    "interval_intersect": f"WITH {_TRACKS} SELECT g.contig_name, greatest(g.a, r.a) AS from_position, least(g.b, r.b) AS to_position FROM gm g JOIN rm r ON g.contig_name = r.contig_name AND g.a <= r.b AND r.a <= g.b",
    "interval_subtract": f"""WITH {_TRACKS}, ev AS (SELECT contig_name, a AS p, 1 AS d, 0 AS x FROM rm UNION ALL SELECT contig_name, b + 1, -1, 0 FROM rm UNION ALL SELECT contig_name, a, 0, 1 FROM gm UNION ALL SELECT contig_name, b + 1, 0, -1 FROM gm),
        st AS (SELECT contig_name, p, sum(d) AS d, sum(x) AS x FROM ev GROUP BY contig_name, p),
        run AS (SELECT contig_name, p, lead(p) OVER w AS nx, sum(d) OVER w AS dd, sum(x) OVER w AS xx FROM st WINDOW w AS (PARTITION BY contig_name ORDER BY p)),
        part AS (SELECT contig_name, p, nx FROM run WHERE dd = 1 AND xx = 0),
        cut AS (SELECT *, CASE WHEN p = lag(nx) OVER (PARTITION BY contig_name ORDER BY p) THEN 0 ELSE 1 END AS s FROM part),
        isl AS (SELECT *, sum(s) OVER (PARTITION BY contig_name ORDER BY p ROWS UNBOUNDED PRECEDING) AS i FROM cut)
        SELECT contig_name, CAST(min(p) AS BIGINT) AS from_position, CAST(max(nx) - 1 AS BIGINT) AS to_position FROM isl GROUP BY contig_name, i""",
    "interval_union": f"WITH {_SPANS}, both_s AS (SELECT sample_name, contig_name, a, b FROM rs UNION ALL SELECT sample_name, contig_name, a, b FROM gs), {_merge_sql('um', 'both_s', 1)} SELECT {_OUT} FROM um",
    "covered_size": f"WITH {_SPANS}, both_s AS (SELECT sample_name, contig_name, a, b FROM rs UNION ALL SELECT sample_name, contig_name, a, b FROM gs), {_merge_sql('um', 'both_s', 1)} SELECT sample_name, contig_name, CAST(sum(b - a + 1) AS BIGINT) AS covered FROM um GROUP BY ALL",
    "coverage_depth": f"WITH {_SPANS}, p AS (SELECT sample_name, contig_name, unnest(range(a, CAST(b + 1 AS BIGINT))) AS pos FROM rs), d AS (SELECT sample_name, contig_name, pos, count(*) AS depth FROM p GROUP BY ALL) SELECT sample_name, depth, count(*) AS n_positions FROM d GROUP BY ALL",
    "loc_relations": f"""WITH {_SPANS}, d AS (SELECT DISTINCT sample_name, contig_name, a, b, {_W} - 50 AS c, {_W} + 49 AS d FROM gs), e AS (SELECT *, greatest(0, least(b, d) - greatest(a, c) + 1) AS shared FROM d)
        SELECT sample_name, contig_name, a AS from_position, CAST(b AS BIGINT) AS to_position, CAST(shared AS BIGINT) AS shared, CAST(greatest(0, greatest(a, c) - least(b, d)) AS BIGINT) AS distance, greatest(a, c) <= least(b, d) + 1 AS contiguous, a <= c AND d <= b AS contains,
        round(least(shared / (b - a + 1), shared / 100), 6) AS reciprocal, CAST(CASE WHEN shared = 0 THEN 1 ELSE CAST(a < c AS INT) + CAST(b > d AS INT) END AS INT) AS pieces_left, CAST(b - a + 1 - shared AS BIGINT) AS size_left FROM e""",
    "loc_parse": "SELECT record_id, contig_name AS contig, CAST(contig_position AS BIGINT) AS from_position, CAST(CASE record_id % 3 WHEN 0 THEN contig_position WHEN 2 THEN contig_position + 10 END AS BIGINT) AS to_position FROM gvcf_records",
}
