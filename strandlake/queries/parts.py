"""Queries on parts of reads, locations, tracks and records of variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import cigar as C
from strandlake.functions import readparts as R
from strandlake.operators import annotations as A
from strandlake.operators import bins, intervals, tracks
from strandlake.operators import variants as V
from strandlake.operators.periods import gvcf_end
from strandlake.queries.calls import _ALTS, _GT, _sv
from strandlake.queries.genome import _BINNED
from strandlake.queries.sqlparts import cigar_sum, contig_key, contigs
from strandlake.sources import sinks
from strandlake.tables import contig_key as key
from strandlake.tables import table, with_contig


def platforms(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "read_groups").withColumn("kind", R.platform(F.col("platform")))
    return rows.select("read_group", "kind", R.sequencer(F.col("kind")).alias("sequencer"), R.is_platform(F.col("platform"), "illumina").alias("is_illumina"))


def read_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("contig_position")
    rows = table(spark, sf, "reads").where(C.has_cigar(F.col("cigar")) & F.col("seq").isNotNull() & ~F.col("seq").isin("", "*") & F.col("base_quals").isNotNull() & (F.length("base_quals") == F.length("seq")))
    return rows.select(
        "record_id", R.high_quality_clips().alias("hq_clips"), R.leading_insertion().alias("first_insertion"), R.trailing_insertion().alias("last_insertion"), R.first_aligned_offset().alias("first_aligned"), R.offset_at(p + 20).alias("offset_20"), R.position_of(F.lit(30)).alias("position_30"),
        R.bases_covering(p + 10, p + 19).alias("covering"), R.soft_start().alias("soft_start"), R.unclipped_start().alias("unclipped_start"), R.overlap_class(p + 5, p + 60, F.lit(True)).alias("at_start"), R.overlap_class(p - 8, p - 3, F.lit(True)).alias("before_start"), R.overlap_class(p - 100, p + 400, F.lit(True)).alias("around"),
    )


def longest_reads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "reads").groupBy("read_group").agg(F.max(F.length("seq")).alias("longest"))


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_contig(table(spark, sf, "gvcf_records"), table(spark, sf, "contigs"), "contig_name", out="contig", code="code")
    lengths = table(spark, sf, "contigs").select(F.col("contig_id").alias("code"), "contig_length")
    return rows.withColumns({"a": F.col("contig_position").cast("bigint"), "b": gvcf_end().cast("bigint")}).join(lengths, "code", "left")


def location_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Each block or site against the ten positions that begin five after it."""
    a, b, c, d = F.col("a"), F.col("b"), F.col("a") + 5, F.col("a") + 14
    union, span, pad = intervals.joined_location(a, b, c, d), intervals.endpoint_span(a, b, c, d), intervals.padded(a, b, 1000, F.col("contig_length"))
    return _blocks(spark, sf).select(
        "record_id", union["from_position"].alias("union_from"), union["to_position"].alias("union_to"), span["from_position"].alias("span_from"), span["to_position"].alias("span_to"), intervals.is_before(b, c).alias("before"), intervals.is_past(a, d).alias("past"),
        intervals.compared(F.col("code").cast("bigint"), a, b, F.col("code").cast("bigint"), c, d).alias("compared"), pad["from_position"].alias("pad_from"), pad["to_position"].alias("pad_to"), intervals.location_fault(a, b + 9_000_000, F.col("contig_length")).alias("fault"),
    )


def _features(spark: SparkSession, sf: str) -> DataFrame:
    feature = lambda df, last, name: df.select(key(F.col("contig_name")).alias("contig"), F.col("contig_position").cast("bigint").alias("from_position"), last.cast("bigint").alias("to_position"), name.alias("name"), V.variant_type(F.col("ref_allele"), F.col("alt")).alias("kind")).where("contig is not null")
    calls = feature(table(spark, sf, "variants"), F.col("contig_position") + F.length("ref_allele") - 1, F.format_string("v%012d", "record_id"))
    blocks = feature(table(spark, sf, "gvcf_records"), gvcf_end(), F.format_string("g%012d", "record_id"))
    return tracks.together({"calls": calls, "blocks": blocks})


def _loci(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "gvcf_records").select(key(F.col("contig_name")).alias("contig"), F.col("contig_position").cast("bigint").alias("position")).where("contig is not null").distinct()


def track_values(spark: SparkSession, sf: str) -> DataFrame:
    """Features at each site of the blocks: all, by track, those that start there, and those of single bases."""
    got = tracks.values_at(_loci(spark, sf), _features(spark, sf))
    marked = got.withColumns({"exact": F.col("from_position") == F.col("position"), "snp": F.col("kind") == "SNP"})
    return marked.groupBy("contig", "position").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("track") == "calls").alias("calls"), F.count_if("exact").alias("exact"), F.count_if("snp").alias("snps"))


def track_first(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.first_value(tracks.values_at(_loci(spark, sf), _features(spark, sf)), ["calls", "blocks"]).select("contig", "position", "track", "name", "kind")


def track_priority(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.sorted_by_priority(tracks.at_exact_start(tracks.values_at(_loci(spark, sf), _features(spark, sf))), ["blocks", "calls"]).select("contig", "position", "name", "place")


def trimmed_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks cut to stretches of 1,000 positions that begin at every 1,500th, one row for each that they meet."""
    rows = _blocks(spark, sf).where("contig is not null and a <= b").select("record_id", "contig", "a", "b")
    pieces = rows.select("contig", F.explode(F.sequence(F.expr("a div 1500"), F.expr("b div 1500"))).alias("k")).distinct().select("contig", (F.col("k") * 1500).alias("from_position"), (F.col("k") * 1500 + 999).alias("to_position"))
    return intervals.trimmed_to(rows, pieces, ["contig"], "a", "b").select("record_id", "a", "b")


def origin_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Reads given to all bins that they overlap, then kept in the bin that they begin in: each once."""
    ctg = table(spark, sf, "contigs")
    every = bins.bin_table(ctg).select("bin_id", F.col("start_position").alias("from_position"), F.col("end_position").alias("to_position"))
    got = intervals.owned_by(bins.with_replicas(table(spark, sf, "reads"), ctg), every, "contig_position")
    return got.groupBy("bin_id").agg(F.count(F.lit(1)).alias("n"), F.sum("record_id").alias("ids"))


def _decoded(spark: SparkSession, sf: str) -> DataFrame:
    return V.decoded(table(spark, sf, "variants"))


def variant_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.genotypes(_decoded(spark, sf))
    alternates = V.alts(F.col("alt"))
    gt = V.sample_value(F.col("format_keys"), F.col("genotype"), "GT")
    return rows.select(
        "record_id", V.pruned_info(F.col("info"), ["DP", "AF"]).alias("pruned"), V.alleles_within(alternates, F.array(*(F.lit(x) for x in "ACGT"))).alias("plain"), F.array_join(V.allele_permutation(alternates, F.array(*(F.lit(x) for x in ("T", "G", "*", "A")))).cast("array<string>"), ",").alias("permutation"),
        F.round(V.mean_alternate_size(F.col("ref_allele"), V.called_alternates(F.col("gt"), alternates)), 6).alias("mean_size"), V.total_ploidy(gt).alias("ploidy"),
    )


def allele_subsets(spark: SparkSession, sf: str) -> DataFrame:
    """Records without their symbolic and spanning alternates."""
    rows = _decoded(spark, sf)
    places = F.transform(V.alts(F.col("alt")), lambda a, i: F.when(~V.is_symbolic(a), i + 1))
    got = V.allele_subset(rows, F.concat(F.array(F.lit(0)), F.array_compact(places)))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return got.select("record_id", text("new_alts").alias("alts"), text("new_ad").alias("ad"), text("new_pl").alias("pl"), F.col("new_gt").alias("gt"))


def encoded_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Records decoded and encoded again: INFO by key, sample values without those missing at the end, shares and sizes as the writer formats them."""
    rows = _decoded(spark, sf)
    info = V.info_map(F.col("info"))
    values = [V.sample_value(F.col("format_keys"), F.col("genotype"), k) for k in ("GT", "AD", "DP", "GQ", "PL")]
    return rows.select("record_id", sinks.info_text(info).alias("info"), sinks.genotype_text(values).alias("genotype"), sinks.format_double(info["FS"].try_cast("double")).alias("fs"), sinks.format_double(info["FS"].try_cast("double") / 1000).alias("small"))


_H = "[!-=]"
_L, _T = "coalesce(TRY_CAST(regexp_extract(cigar, '^(?:\\d+H)?(\\d+)S', 1) AS INT), 0)", "coalesce(TRY_CAST(regexp_extract(cigar, '(\\d+)S(?:\\d+H)?$', 1) AS INT), 0)"
_P = f"""pr AS (SELECT *, CAST(regexp_extract_all(cigar, '(\\d+)[MIDNSHP=X]', 1) AS BIGINT[]) AS lens, regexp_extract_all(cigar, '\\d+([MIDNSHP=X])', 1) AS ops, {_L} AS ls, {_T} AS ts, {cigar_sum("SH", "regexp_extract(cigar, '^((\\d+[SH])+)', 1)")} AS lc, {cigar_sum("SH", "regexp_extract(cigar, '[^0-9SH]((\\d+[SH])+)$', 1)")} AS tc, {cigar_sum("MDN=X")} AS rl
    FROM reads WHERE cigar <> '*' AND cigar <> '' AND seq NOT IN ('', '*') AND length(base_quals) = length(seq)),
pl AS (SELECT *, list_transform(range(1, len(ops) + 1), lambda i: {{'op': ops[i], 'len': lens[i], 'ref': contig_position + coalesce(list_sum(list_transform(range(1, i), lambda j: CASE WHEN ops[j] IN ('M', 'D', 'N', '=', 'X') THEN lens[j] ELSE 0 END)), 0),
    'off': coalesce(list_sum(list_transform(range(1, i), lambda j: CASE WHEN ops[j] IN ('M', 'I', 'S', '=', 'X') THEN lens[j] ELSE 0 END)), 0)}}) AS po FROM pr)"""


def _at(position: str) -> str:
    hit = f"list_filter(po, lambda x: x.op IN ('M', '=', 'X') AND x.ref <= {position} AND {position} < x.ref + x.len)[1]"
    return f"CAST({hit}.off + ({position} - {hit}.ref) AS INT)"


def _class(first: str, last: str) -> str:
    s, e, us, ue = "(contig_position - ls)", "(contig_position + rl - 1 + ts)", "(contig_position - lc)", "(contig_position + rl - 1 + tc)"
    return f"""CASE WHEN {ue} < {first} THEN 'NO_OVERLAP_LEFT' WHEN {us} > {last} THEN 'NO_OVERLAP_RIGHT' WHEN {e} < {first} THEN 'NO_OVERLAP_HARDCLIPPED_LEFT' WHEN {s} > {last} THEN 'NO_OVERLAP_HARDCLIPPED_RIGHT'
        WHEN {s} >= {first} AND {e} <= {last} THEN 'OVERLAP_CONTAINED' WHEN {s} < {first} AND {e} > {last} THEN 'OVERLAP_LEFT_AND_RIGHT' WHEN {s} < {first} THEN 'OVERLAP_LEFT' ELSE 'OVERLAP_RIGHT' END"""


_BLOCK = f"""known AS ({contigs()}), gk AS (SELECT *, {contig_key()} AS k, TRY_CAST(regexp_extract(info, '(^|;)END=([0-9]+)(;|$)', 2) AS BIGINT) AS en FROM gvcf_records),
bl AS (SELECT gk.*, cname, cid, clen, CAST(contig_position AS BIGINT) AS a, CAST(CASE WHEN en >= contig_position THEN en ELSE contig_position + length(ref_allele) - 1 END AS BIGINT) AS b FROM gk LEFT JOIN known ON ckey = k)"""
_KIND = f"(SELECT CASE WHEN len(ks) = 0 THEN 'NO_VARIATION' WHEN len(list_filter(ks, lambda x: x <> 'SYMBOLIC')) = 0 THEN 'SYMBOLIC' WHEN len(list_filter(ks, lambda x: x <> 'SYMBOLIC')) > 1 THEN 'MIXED' ELSE list_filter(ks, lambda x: x <> 'SYMBOLIC')[1] END FROM (SELECT list_distinct(list_transform({_ALTS}, lambda x: CASE WHEN x LIKE '<%' OR x = '*' THEN 'SYMBOLIC' WHEN length(x) <> length(ref_allele) THEN 'INDEL' WHEN length(x) = 1 THEN 'SNP' ELSE 'MNP' END)) AS ks))"
_TRACKS = f"""{_BLOCK}, ft AS (SELECT 'calls' AS track, {contig_key()} AS contig, CAST(contig_position AS BIGINT) AS f, CAST(contig_position + length(ref_allele) - 1 AS BIGINT) AS t, printf('v%012d', record_id) AS name, ref_allele, alt FROM variants UNION ALL SELECT 'blocks', k, a, b, printf('g%012d', record_id), ref_allele, alt FROM bl),
fk AS (SELECT track, contig, f, t, name, {_KIND} AS kind FROM ft WHERE contig IS NOT NULL), lo AS (SELECT DISTINCT k AS contig, CAST(contig_position AS BIGINT) AS position FROM gk WHERE k IS NOT NULL),
tv AS (SELECT lo.contig, position, track, f, t, name, kind FROM lo JOIN fk ON fk.contig = lo.contig AND position BETWEEN f AND t)"""
#: Half away from zero on the decimal text, as the writer rounds.
_SIZE = "CASE WHEN abs({x}) >= 1 THEN CAST(CAST(round(CAST({x} AS DECIMAL(18, 9)), 2) AS DECIMAL(18, 2)) AS VARCHAR) WHEN abs({x}) >= 0.01 THEN CAST(CAST(round(CAST({x} AS DECIMAL(18, 9)), 3) AS DECIMAL(18, 3)) AS VARCHAR) WHEN abs({x}) > 1e-20 THEN printf('%.3e', {x}) ELSE '0.00' END"
_PAIRS = "list_filter(flatten(list_transform(range(1, len(kp) + 1), lambda j: list_transform(range(1, j + 1), lambda i: [i, j]))), lambda p: TRUE)"

QUERIES = {
    f.__name__: f
    for f in (
        platforms, read_parts, longest_reads, location_functions, track_values, track_first, track_priority, trimmed_blocks, origin_reads, variant_parts, allele_subsets, encoded_variants,
    )
}

ORACLES = {
    "platforms": """WITH k AS (SELECT read_group, platform, CASE WHEN platform IS NULL THEN NULL WHEN regexp_matches(upper(platform), 'ILLUMINA|SLX|SOLEXA') THEN 'ILLUMINA' WHEN contains(upper(platform), 'SOLID') THEN 'SOLID' WHEN contains(upper(platform), '454') THEN 'LS454' WHEN contains(upper(platform), 'COMPLETE') THEN 'COMPLETE_GENOMICS'
        WHEN contains(upper(platform), 'PACBIO') THEN 'PACBIO' WHEN contains(upper(platform), 'IONTORRENT') THEN 'ION_TORRENT' WHEN contains(upper(platform), 'CAPILLARY') THEN 'CAPILLARY' WHEN contains(upper(platform), 'HELICOS') THEN 'HELICOS' ELSE 'UNKNOWN' END AS kind FROM read_groups)
        SELECT read_group, kind, CASE WHEN kind IN ('LS454', 'ION_TORRENT') THEN 'FLOW' WHEN kind IN ('UNKNOWN', 'CAPILLARY') THEN 'OTHER' ELSE 'DISCRETE' END AS sequencer, coalesce(contains(upper(platform), 'ILLUMINA'), FALSE) AS is_illumina FROM k""",
    "read_parts": f"""WITH {_P} SELECT record_id, CAST(length(regexp_replace(left(base_quals, ls) || right(base_quals, ts), '{_H}', '', 'g')) AS INT) AS hq_clips, coalesce(TRY_CAST(regexp_extract(cigar, '^(\\d+)I', 1) AS INT), 0) AS first_insertion, coalesce(TRY_CAST(regexp_extract(cigar, '(\\d+)I$', 1) AS INT), 0) AS last_insertion,
        CAST(list_filter(po, lambda x: x.op IN ('M', '=', 'X'))[1].off AS INT) AS first_aligned, {_at('contig_position + 20')} AS offset_20, CAST(list_filter(po, lambda x: x.op IN ('M', '=', 'X') AND x.off <= 30 AND 30 < x.off + x.len)[1].ref + 30 - list_filter(po, lambda x: x.op IN ('M', '=', 'X') AND x.off <= 30 AND 30 < x.off + x.len)[1].off AS BIGINT) AS position_30,
        CASE WHEN {_at('contig_position + 10')} IS NOT NULL AND {_at('contig_position + 19')} IS NOT NULL THEN substr(seq, {_at('contig_position + 10')} + 1, {_at('contig_position + 19')} - {_at('contig_position + 10')} + 1) END AS covering, CAST(contig_position - ls AS INT) AS soft_start, CAST(contig_position - lc AS BIGINT) AS unclipped_start,
        {_class('contig_position + 5', 'contig_position + 60')} AS at_start, {_class('contig_position - 8', 'contig_position - 3')} AS before_start, {_class('contig_position - 100', 'contig_position + 400')} AS around FROM pl""",
    "longest_reads": "SELECT read_group, CAST(max(length(seq)) AS INT) AS longest FROM reads GROUP BY read_group",
    "location_functions": f"""WITH {_BLOCK} SELECT record_id, CASE WHEN greatest(a, a + 5) <= least(b, a + 14) + 1 THEN least(a, a + 5) END AS union_from, CASE WHEN greatest(a, a + 5) <= least(b, a + 14) + 1 THEN greatest(b, a + 14) END AS union_to, least(a, a + 5) AS span_from, greatest(b, a + 14) AS span_to, b < a + 5 AS before, a > a + 14 AS past, -1 AS compared,
        greatest(1, a - 1000) AS pad_from, least(clen, b + 1000) AS pad_to, CASE WHEN clen IS NULL THEN 'contig' WHEN a > b + 9000000 THEN 'order' WHEN a < 1 THEN 'start' WHEN b + 9000000 > clen THEN 'stop' END AS fault FROM bl""",
    "track_values": f"WITH {_TRACKS} SELECT contig, position, count(*) AS n, count(*) FILTER (WHERE track = 'calls') AS calls, count(*) FILTER (WHERE f = position) AS exact, count(*) FILTER (WHERE kind = 'SNP') AS snps FROM tv GROUP BY ALL",
    "track_first": f"WITH {_TRACKS}, o AS (SELECT *, row_number() OVER (PARTITION BY contig, position ORDER BY track = 'blocks', f, name) AS p FROM tv) SELECT contig, position, track, name, kind FROM o WHERE p = 1",
    "track_priority": f"WITH {_TRACKS} SELECT contig, position, name, CAST(row_number() OVER (PARTITION BY contig, position ORDER BY track = 'calls', f, name) AS INT) AS place FROM tv WHERE f = position",
    "trimmed_blocks": f"WITH {_BLOCK}, x AS (SELECT record_id, a, b, unnest(range(a // 1500, b // 1500 + 1)) * 1500 AS s FROM bl WHERE cname IS NOT NULL AND a <= b) SELECT record_id, greatest(a, s) AS a, least(b, s + 999) AS b FROM x WHERE greatest(a, s) <= least(b, s + 999)",
    "origin_reads": f"WITH {_BINNED} SELECT bin_id, count(*) AS n, CAST(sum(record_id) AS BIGINT) AS ids FROM binned WHERE bin_id IS NOT NULL GROUP BY bin_id",
    "variant_parts": f"""WITH {_GT}, q AS (SELECT *, {_ALTS} AS al, list_filter(string_split(coalesce(info, ''), ';'), lambda x: string_split(x, '=')[1] IN ('DP', 'AF')) AS kept, {_sv('GT')} AS gtt, list_distinct(list_filter(gt, lambda g: g > 0)) AS used FROM gts),
        r AS (SELECT *, list_filter(list_transform(used, lambda g: al[g]), lambda x: x IS NOT NULL) AS ca FROM q) SELECT record_id, CASE WHEN len(kept) > 0 THEN array_to_string(kept, ';') ELSE '.' END AS pruned, len(list_filter(al, lambda x: x NOT IN ('A', 'C', 'G', 'T'))) = 0 AS plain, array_to_string(list_transform(al, lambda x: coalesce(list_position(['T', 'G', '*', 'A'], x), 0) - 1), ',') AS permutation,
        CASE WHEN len(ca) > 0 THEN round(list_sum(list_transform(ca, lambda x: CASE WHEN x LIKE '<%' OR x = '*' THEN 1 WHEN length(x) = length(ref_allele) THEN len(list_filter(range(1, length(x) + 1), lambda i: substr(x, i, 1) <> substr(ref_allele, i, 1))) ELSE abs(length(x) - length(ref_allele)) END)) / len(ca), 6) END AS mean_size, CAST(CASE WHEN gtt IS NULL THEN 0 ELSE len(string_split_regex(gtt, '[/|]')) END AS INT) AS ploidy FROM r""",
    "allele_subsets": f"""WITH {_GT}, q AS (SELECT *, {_ALTS} AS al, list_transform(string_split({_sv('PL')}, ','), lambda x: TRY_CAST(x AS INT)) AS pl FROM gts), k AS (SELECT *, list_concat([0], list_filter(range(1, len(al) + 1), lambda i: NOT (al[i] LIKE '<%' OR al[i] = '*'))) AS kp FROM q),
        p AS (SELECT *, {_PAIRS} AS pairs FROM k), n AS (SELECT *, CASE WHEN len(pl) = (len(al) + 1) * (len(al) + 2) / 2 THEN list_transform(pairs, lambda x: pl[CAST(kp[x[2]] * (kp[x[2]] + 1) / 2 + kp[x[1]] + 1 AS INT)]) END AS np FROM p), m AS (SELECT *, list_transform(np, lambda x: x - list_min(np)) AS nn FROM n)
        SELECT record_id, array_to_string(list_transform(list_filter(kp, lambda i: i > 0), lambda i: al[i]), ',') AS alts, CASE WHEN len(ad) = len(al) + 1 THEN array_to_string(list_transform(kp, lambda i: ad[i + 1]), ',') END AS ad, array_to_string(nn, ',') AS pl,
        CASE WHEN nn IS NULL OR len(list_filter(nn, lambda x: x IS NULL)) > 0 THEN './.' ELSE (pairs[list_position(nn, 0)][1] - 1) || '/' || (pairs[list_position(nn, 0)][2] - 1) END AS gt FROM m""",
    "encoded_variants": f"""WITH {_GT}, q AS (SELECT *, list_filter(string_split(coalesce(info, ''), ';'), lambda x: x NOT IN ('', '.')) AS il, TRY_CAST(nullif(regexp_extract(info, '(?:^|;)FS=([^;]*)', 1), '') AS DOUBLE) AS fs FROM gts),
        t AS (SELECT *, array_to_string(list_transform([{_sv('GT')}, {_sv('AD')}, {_sv('DP')}, {_sv('GQ')}, {_sv('PL')}], lambda x: coalesce(x, '.')), ':') AS g FROM q)
        SELECT record_id, CASE WHEN len(il) > 0 THEN array_to_string(list_transform(list_sort(list_transform(il, lambda x: [string_split(x, '=')[1], x])), lambda p: p[2]), ';') ELSE '.' END AS info, regexp_replace(g, '(:\\.)+$', '') AS genotype,
        {_SIZE.format(x='fs')} AS fs, {_SIZE.format(x='(fs / 1000)')} AS small FROM t""",
}
