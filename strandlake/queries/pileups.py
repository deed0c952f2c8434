"""Queries on pileups, bases and qualities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import bases as B
from strandlake.functions import cigar as C
from strandlake.functions import quality as Q
from strandlake.operators import filters, pileup, reference, tallies, walks
from strandlake.queries.genome import _kept
from strandlake.queries.sqlparts import cigar_sum, contig_key, contigs
from strandlake.session import spread
from strandlake.tables import table


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.elements(*(table(spark, sf, n) for n in ("reads", "read_groups", "contigs")))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return tallies.position_counts(*(table(spark, sf, n) for n in ("reads", "read_groups", "contigs")))


def _consensus(spark: SparkSession, sf: str) -> DataFrame:
    return tallies.consensus(_counts(spark, sf))


def _mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return walks.mismatches(pileup.read_rows(*(table(spark, sf, n) for n in ("reads", "read_groups", "contigs"))))


def pileup_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tallies.base_counts(_counts(spark, sf))


def pileup_sample_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Positions, bases and deletions per sample and strand."""
    els = _elements(spark, sf)
    per = els.groupBy("sample", "is_reverse", *pileup.LOCUS).agg(F.count_if(~F.col("is_deletion")).alias("d"), F.count_if("is_deletion").alias("x"))
    return per.groupBy("sample", "is_reverse").agg(F.count(F.lit(1)).alias("n_positions"), F.sum("d").alias("n_bases"), F.sum("x").alias("n_deletions"), F.max("d").alias("max_depth"))


def consensus_bases(spark: SparkSession, sf: str) -> DataFrame:
    return _consensus(spark, sf).groupBy("contig", "ref").agg(F.count(F.lit(1)).alias("n"))


def strand_table(spark: SparkSession, sf: str) -> DataFrame:
    return tallies.strand_tables(_counts(spark, sf))


def allele_fraction(spark: SparkSession, sf: str) -> DataFrame:
    t = strand_table(spark, sf)
    alt, all_ = F.col("alt_forward") + F.col("alt_reverse"), F.col("ref_forward") + F.col("ref_reverse") + F.col("alt_forward") + F.col("alt_reverse")
    return t.select("contig", "position", "ref", "alt", F.round(alt / all_, 6).alias("fraction"))


def quality_sums(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.quality_sums(_elements(spark, sf))


def fragment_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Depth of each position with one element per fragment, where that differs from the plain depth."""
    els = _elements(spark, sf)
    plain = els.groupBy(*pileup.LOCUS).agg(F.count(F.lit(1)).alias("plain"))
    once = pileup.one_per_fragment(els).groupBy(*pileup.LOCUS).agg(F.count(F.lit(1)).alias("once"))
    return plain.where("plain > 1").join(once, pileup.LOCUS, "left").fillna(0, ["once"]).where("once <> plain")


def indel_alleles(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.indel_alleles(_elements(spark, sf))


def pileup_strings(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.pileup_strings(_elements(spark, sf))


def quality_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Elements per sample under the base and mapping quality filters."""
    els = _elements(spark, sf)
    rules = {"all": els, "base_20": pileup.quality_filtered(els, 20), "mapping_30": pileup.quality_filtered(els, min_mapping=30), "both": pileup.quality_filtered(els, 20, 30), "not_map_q_zero": els.where("map_q > 0")}
    parts = [d.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit(k)) for k, d in rules.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Mismatches with the consensus and the sum of their qualities, per read that has any."""
    return _mismatches(spark, sf).groupBy("record_id").agg(F.count(F.lit(1)).alias("mismatches"), F.coalesce(F.sum("qual"), F.lit(0)).alias("qual_sum"))


def reference_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The reference that each read covers, with 5 bases around it, from slices of the consensus."""
    rows = pileup.read_rows(*(table(spark, sf, n) for n in ("reads", "read_groups", "contigs"))).select("record_id", "contig", "contig_position", "cigar")
    rows = rows.withColumn("end", F.col("contig_position") + C.reference_length(F.col("cigar")) - 1)
    refs = reference.slices(_consensus(spark, sf))
    return reference.with_reference(rows, refs, "contig_position", "end", padding=5).select("record_id", "ref_start", "ref_seq")


def base_functions(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("seq")
    return table(spark, sf, "reads").where("seq is not null and seq <> '*' and seq <> ''").select(
        "record_id", B.base_index(F.substring(s, 1, 1)).alias("first_index"), B.is_regular(F.substring(s, 1, 1)).alias("first_regular"), B.reverse_complement(s).alias("revcomp"), B.iupac_to_n(s).alias("cleaned"),
        B.substitution_class(F.substring(s, 1, 1), F.substring(s, 2, 1)).alias("step_class"), B.context(s, F.lit(3), 3).alias("context3"), B.flanked(s, F.lit(4)).alias("flanked"), F.round(B.complexity(s), 6).alias("complexity"), B.repeat_count(s, "A").cast("int").alias("leading_a"),
    )


def cigar_functions(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("cigar")
    return table(spark, sf, "reads").where(C.has_cigar(c)).select(
        "record_id", C.reference_length(c).alias("ref_len"), C.read_length(c).alias("read_len"), C.leading_clip(c).alias("lead_clip"), C.trailing_clip(c).alias("trail_clip"), F.size(F.filter(C.operations(c), lambda o: o["op"] == "M")).alias("blocks"), F.round(filters.soft_clip_share(), 6).alias("soft_share"),
        C._sum_of(c, "H").alias("hard_bases"), F.concat_ws("", F.transform(F.reverse(C.operations(c)), lambda o: F.concat(o["len"].cast("string"), o["op"]))).alias("inverted"),
    )


def kmer_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "reads")).where("seq is not null").select(F.explode(B.kmers(F.upper("seq"), 8)).alias("kmer"))
    return rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def nonunique_kmers(spark: SparkSession, sf: str) -> DataFrame:
    """10-mers that a read holds more than once."""
    k = B.kmers(F.upper("seq"), 10)
    rows = table(spark, sf, "reads").where("seq is not null").select("record_id", F.explode(k).alias("kmer"))
    return rows.groupBy("record_id", "kmer").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def phred_functions(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("map_q")
    return table(spark, sf, "reads").where("map_q is not null").select("map_q").distinct().select(
        "map_q", F.round(Q.qual_to_error(q), 9).alias("error"), F.round(Q.qual_to_probability(q), 9).alias("probability"), F.round(Q.qual_to_error_log10(q), 6).alias("error_log10"), Q.bounded(q).alias("bounded"), Q.error_to_qual(Q.qual_to_error(q)).alias("back"),
        F.round(F.when(q > 0, Q.log10_one_minus(-q / 10.0)), 9).alias("log10_one_minus"), F.round(Q.log10_sum(F.array(-q / 10.0, F.lit(-1.0), F.lit(-2.0))), 9).alias("log10_sum"), F.round(Q.normal_density(q.cast("double"), 30.0, 10.0), 9).alias("density"),
    )


def array_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Upper median, median absolute deviation and root mean square of the mapping qualities, per read group."""
    rows = table(spark, sf, "reads").where("map_q is not null and map_q <> 255 and read_group is not null")
    hist = rows.groupBy("read_group", "map_q").agg(F.count(F.lit(1)).alias("n"))
    # A quality has at most 255 values, so the medians come from the histogram.
    packed = hist.groupBy("read_group").agg(F.sort_array(F.collect_list(F.struct("map_q", "n"))).alias("h"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("map_q") * F.col("map_q")).alias("sq"))
    upper = F.aggregate("h", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("at")), lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + x["n"] > F.floor(F.col("n") / 2), x["map_q"])).alias("at")), lambda a: a["at"])
    return packed.select("read_group", "n", upper.alias("upper_median"), F.round(F.sqrt(F.col("sq") / F.col("n")), 6).alias("rms"))


#: Parts that are read several times are made once, or DuckDB expands them anew for each reader.
_ELEMENTS = f"""known AS ({contigs()}),
pr AS (SELECT r.*, sample_name AS sample, cname AS contig, regexp_replace(read_name, '/[12]$', '') AS name, flag & 16 <> 0 AS is_reverse, CASE WHEN base_quals IN ('', '*') THEN NULL ELSE base_quals END AS quals,
    CAST(regexp_extract_all(cigar, '(\\d+)[MIDNSHP=X]', 1) AS BIGINT[]) AS lens, regexp_extract_all(cigar, '\\d+([MIDNSHP=X])', 1) AS ops
    FROM (SELECT *, {contig_key()} AS k FROM reads WHERE {_kept(filters.PRESETS["locus_walker"])}) r JOIN known ON ckey = k LEFT JOIN read_groups USING (read_group) WHERE cigar <> '*' AND cigar <> '' AND contig_position >= 1 AND seq NOT IN ('', '*')),
opr AS (SELECT *, unnest(range(1, len(ops) + 1)) AS i FROM pr),
opp AS (SELECT *, ops[i] AS op, lens[i] AS l, contig_position + coalesce(list_sum(list_transform(range(1, i), lambda j: CASE WHEN ops[j] IN ('M', 'D', 'N', '=', 'X') THEN lens[j] ELSE 0 END)), 0) AS rf,
    coalesce(list_sum(list_transform(range(1, i), lambda j: CASE WHEN ops[j] IN ('M', 'I', 'S', '=', 'X') THEN lens[j] ELSE 0 END)), 0) AS off FROM opr),
exl AS (SELECT *, unnest(range(0, CAST(l AS BIGINT))) AS o FROM opp WHERE op IN ('M', '=', 'X', 'D')),
els AS MATERIALIZED (SELECT record_id, sample, contig, name, is_reverse, map_q, read_group, flag, length(seq) AS read_length, CAST(rf + o AS BIGINT) AS position, op = 'D' AS is_deletion, CASE WHEN op <> 'D' THEN upper(substr(seq, CAST(off + o + 1 AS BIGINT), 1)) END AS base,
    CASE WHEN op <> 'D' THEN ascii(substr(quals, CAST(off + o + 1 AS BIGINT), 1)) - 33 END AS qual, CASE WHEN op = 'D' THEN off - 1 ELSE off + o END AS read_offset,
    CASE WHEN op <> 'D' AND o = l - 1 AND ops[i + 1] IN ('I', 'D') THEN ops[i + 1] END AS next_op, CASE WHEN op <> 'D' AND o = l - 1 AND ops[i + 1] IN ('I', 'D') THEN lens[i + 1] END AS next_len,
    CASE WHEN op <> 'D' AND o = l - 1 AND ops[i + 1] = 'I' THEN substr(seq, CAST(off + o + 2 AS BIGINT), lens[i + 1]) END AS inserted FROM exl)"""
_CONSENSUS = """cb AS MATERIALIZED (SELECT contig, position, base, count(*) AS n FROM els WHERE base IN ('A', 'C', 'G', 'T') GROUP BY ALL),
cons AS MATERIALIZED (SELECT contig, position, base AS ref FROM (SELECT *, row_number() OVER (PARTITION BY contig, position ORDER BY n DESC, base) AS p FROM cb) WHERE p = 1)"""
_STRANDS = """sb AS MATERIALIZED (SELECT contig, position, base, count(*) FILTER (WHERE NOT is_reverse) AS f, count(*) FILTER (WHERE is_reverse) AS r FROM els WHERE base IN ('A', 'C', 'G', 'T') GROUP BY ALL),
alts AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY contig, position ORDER BY f + r DESC, base) AS p FROM sb JOIN cons USING (contig, position) WHERE base <> ref),
strands AS (SELECT a.contig, a.position, a.ref, a.base AS alt, coalesce(s.f, 0) AS ref_forward, coalesce(s.r, 0) AS ref_reverse, a.f AS alt_forward, a.r AS alt_reverse
    FROM alts a LEFT JOIN sb s ON s.contig = a.contig AND s.position = a.position AND s.base = a.ref WHERE p = 1)"""
_RULES = {"all": "TRUE", "base_20": "is_deletion OR qual >= 20", "mapping_30": "map_q >= 30", "both": "map_q >= 30 AND (is_deletion OR qual >= 20)", "not_map_q_zero": "map_q > 0"}
_SEQ = "reads WHERE seq IS NOT NULL AND seq <> '*' AND seq <> ''"
_REVCOMP = "reverse(translate(seq, 'ACGTacgtNn', 'TGCAtgcaNn'))"

QUERIES = {
    f.__name__: f
    for f in (
        pileup_counts, pileup_sample_depth, consensus_bases, strand_table, allele_fraction, quality_sums, fragment_overlaps, indel_alleles, pileup_strings, quality_filters, read_mismatches, reference_windows, base_functions, cigar_functions, kmer_counts,
        nonunique_kmers, phred_functions, array_statistics,
    )
}

ORACLES = {
    "pileup_counts": f"WITH {_ELEMENTS} SELECT contig, position, count(*) FILTER (WHERE NOT is_deletion) AS depth, count(*) FILTER (WHERE is_deletion) AS deletions, "
    + ", ".join(f"count(*) FILTER (WHERE base = '{b}') AS n_{b.lower()}" for b in "ACGTN")
    + ", count(*) FILTER (WHERE NOT is_deletion AND NOT is_reverse) AS forward, count(*) FILTER (WHERE NOT is_deletion AND is_reverse) AS reverse, count(*) FILTER (WHERE map_q = 0) AS map_q_zero, count(*) FILTER (WHERE next_op = 'I') AS insertions_follow, count(*) FILTER (WHERE next_op = 'D') AS deletions_follow FROM els GROUP BY contig, position",
    "pileup_sample_depth": f"WITH {_ELEMENTS}, p AS (SELECT sample, is_reverse, contig, position, count(*) FILTER (WHERE NOT is_deletion) AS d, count(*) FILTER (WHERE is_deletion) AS x FROM els GROUP BY ALL) SELECT sample, is_reverse, count(*) AS n_positions, CAST(sum(d) AS BIGINT) AS n_bases, CAST(sum(x) AS BIGINT) AS n_deletions, max(d) AS max_depth FROM p GROUP BY ALL",
    "consensus_bases": f"WITH {_ELEMENTS}, {_CONSENSUS} SELECT contig, ref, count(*) AS n FROM cons GROUP BY ALL",
    "strand_table": f"WITH {_ELEMENTS}, {_CONSENSUS}, {_STRANDS} SELECT * FROM strands",
    "allele_fraction": f"WITH {_ELEMENTS}, {_CONSENSUS}, {_STRANDS} SELECT contig, position, ref, alt, round((alt_forward + alt_reverse) / (ref_forward + ref_reverse + alt_forward + alt_reverse), 6) AS fraction FROM strands",
    "quality_sums": f"WITH {_ELEMENTS} SELECT contig, position, base, count(*) AS n, CAST(sum(qual) AS BIGINT) AS qual_sum FROM els WHERE base IS NOT NULL GROUP BY ALL",
    "fragment_overlaps": f"""WITH {_ELEMENTS}, g AS (SELECT contig, position, sample, name, count(*) AS n, count(DISTINCT coalesce(base, '-')) AS b FROM els GROUP BY ALL),
        t AS (SELECT contig, position, CAST(sum(n) AS BIGINT) AS plain, count(*) FILTER (WHERE b = 1) AS once FROM g GROUP BY ALL) SELECT * FROM t WHERE plain > 1 AND once <> plain""",
    "indel_alleles": f"""WITH {_ELEMENTS}, t AS (SELECT contig, position, CASE next_op WHEN 'I' THEN '+' || upper(inserted) WHEN 'D' THEN '-' || next_len END AS indel, is_deletion FROM els), d AS (SELECT contig, position, count(*) FILTER (WHERE NOT is_deletion) AS depth FROM t GROUP BY ALL),
        c AS (SELECT contig, position, indel, count(*) FILTER (WHERE NOT is_deletion) AS n FROM t WHERE indel IS NOT NULL GROUP BY ALL) SELECT contig, position, indel, n, depth FROM c JOIN d USING (contig, position) WHERE n >= 2 AND n >= 0.25 * depth""",
    "pileup_strings": f"""WITH {_ELEMENTS} SELECT contig, position, CAST(0 AS INT) AS chunk, string_agg(CASE WHEN is_deletion THEN '*' WHEN is_reverse THEN lower(base) ELSE base END, '' ORDER BY record_id) AS bases, string_agg(chr(CAST(coalesce(qual, 0) + 33 AS INT)), '' ORDER BY record_id) AS quals FROM els GROUP BY contig, position""",
    "quality_filters": f"WITH {_ELEMENTS} " + " UNION ALL ".join(f"SELECT sample, count(*) AS n, '{k}' AS rule FROM els WHERE {w} GROUP BY sample" for k, w in _RULES.items()),
    "read_mismatches": f"WITH {_ELEMENTS}, {_CONSENSUS} SELECT record_id, count(*) AS mismatches, CAST(coalesce(sum(qual), 0) AS BIGINT) AS qual_sum FROM els JOIN cons USING (contig, position) WHERE base IN ('A', 'C', 'G', 'T') AND base <> ref GROUP BY record_id",
    "reference_windows": f"""WITH {_ELEMENTS}, {_CONSENSUS}, rw AS (SELECT record_id, cname AS contig, greatest(1, contig_position - 5) AS a, contig_position + {cigar_sum("MDN=X")} - 1 + 5 AS b FROM (SELECT *, {contig_key()} AS k FROM reads WHERE {_kept(filters.PRESETS["locus_walker"])}) r JOIN known ON ckey = k
        WHERE cigar <> '*' AND cigar <> '' AND contig_position >= 1), x AS (SELECT record_id, contig, a, unnest(range(CAST(a AS BIGINT), CAST(b + 1 AS BIGINT))) AS position FROM rw)
        SELECT record_id, CAST(a AS BIGINT) AS ref_start, string_agg(coalesce(ref, 'N'), '' ORDER BY x.position) AS ref_seq FROM x LEFT JOIN cons USING (contig, position) GROUP BY record_id, a""",
    "base_functions": f"""SELECT record_id, CAST(instr('ACGT', upper(substr(seq, 1, 1))) - 1 AS INT) AS first_index, upper(substr(seq, 1, 1)) IN ('A', 'C', 'G', 'T') AS first_regular, {_REVCOMP} AS revcomp, regexp_replace(seq, '[^ACGTNacgtn.*-]', 'N', 'g') AS cleaned,
        CASE WHEN upper(substr(seq, 1, 1)) NOT IN ('A', 'C', 'G', 'T') OR upper(substr(seq, 2, 1)) NOT IN ('A', 'C', 'G', 'T') OR upper(substr(seq, 1, 1)) = upper(substr(seq, 2, 1)) THEN NULL WHEN upper(substr(seq, 1, 2)) IN ('AG', 'GA', 'CT', 'TC') THEN 'transition' ELSE 'transversion' END AS step_class,
        CASE WHEN regexp_full_match(substr(seq, 2, 3), '[ACGT]{{3}}') THEN substr(seq, 2, 3) END AS context3, substr(seq, 2, 3) || 'x' || substr(seq, 6, 3) AS flanked,
        round(len(list_distinct(list_transform(range(1, length(seq) - 1), lambda i: substr(seq, i, 3)))) / (length(seq) - 2), 6) AS complexity, CAST(length(regexp_extract(seq, '^A+')) AS INT) AS leading_a FROM {_SEQ}""",
    "cigar_functions": rf"""SELECT record_id, CAST({cigar_sum("MDN=X")} AS BIGINT) AS ref_len, CAST({cigar_sum("MIS=X")} AS BIGINT) AS read_len, CAST({cigar_sum("SH", r"regexp_extract(cigar, '^((\d+[SH])+)', 1)")} AS BIGINT) AS lead_clip,
        CAST({cigar_sum("SH", r"regexp_extract(cigar, '[^0-9SH]((\d+[SH])+)$', 1)")} AS BIGINT) AS trail_clip, CAST(len(regexp_extract_all(cigar, '\d+M')) AS INT) AS blocks, round({cigar_sum("S")} / {cigar_sum("MIDNSHP=X")}, 6) AS soft_share, CAST({cigar_sum("H")} AS BIGINT) AS hard_bases,
        list_aggregate(list_reverse(regexp_extract_all(cigar, '\d+[MIDNSHP=X]')), 'string_agg', '') AS inverted FROM reads WHERE cigar <> '*' AND cigar <> ''""",
    "kmer_counts": "SELECT kmer, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(seq) - 6), lambda i: substr(upper(seq), i, 8))) AS kmer FROM reads WHERE length(seq) >= 8) GROUP BY kmer",
    "nonunique_kmers": "SELECT record_id, kmer, count(*) AS n FROM (SELECT record_id, unnest(list_transform(range(1, length(seq) - 8), lambda i: substr(upper(seq), i, 10))) AS kmer FROM reads WHERE length(seq) >= 10) GROUP BY ALL HAVING count(*) > 1",
    "phred_functions": """SELECT DISTINCT map_q, round(pow(10, map_q / -10.0), 9) AS error, round(1 - pow(10, map_q / -10.0), 9) AS probability, round(map_q / -10.0, 6) AS error_log10, greatest(1, least(map_q, 93)) AS bounded, greatest(1, least(map_q, 93)) AS back,
        CASE WHEN map_q > 0 THEN round(log10(1 - pow(10, map_q / -10.0)), 9) END AS log10_one_minus, round(log10(pow(10, map_q / -10.0) + 0.1 + 0.01), 9) AS log10_sum, round(exp(-pow((map_q - 30.0) / 10.0, 2) / 2) / (10.0 * sqrt(2 * pi())), 9) AS density FROM reads WHERE map_q IS NOT NULL""",
    "array_statistics": """SELECT read_group, count(*) AS n, list_sort(list(map_q))[count(*) // 2 + 1] AS upper_median, round(sqrt(avg(CAST(map_q AS DOUBLE) * map_q)), 6) AS rms FROM reads WHERE map_q IS NOT NULL AND map_q <> 255 AND read_group IS NOT NULL GROUP BY read_group""",
}
