"""Queries on variant records, reference blocks and site annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import annotations as A
from strandlake.operators import pileup, tallies
from strandlake.operators import variants as V
from strandlake.queries.pileups import _CONSENSUS, _ELEMENTS, _STRANDS, _counts, _elements
from strandlake.queries.sqlparts import contig_key, contigs
from strandlake.tables import table


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    return V.decoded(table(spark, sf, "variants"))


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    return A.genotypes(_variants(spark, sf))


def variant_decode(spark: SparkSession, sf: str) -> DataFrame:
    """INFO and sample columns of the encoded calls."""
    rows = _variants(spark, sf).withColumn("m", V.info_map(F.col("info")))
    return rows.select("record_id", F.col("m")["DP"].alias("dp"), F.col("m")["AF"].alias("af"), F.size("m").alias("n_info"), V.sample_value(F.col("format_keys"), F.col("genotype"), "GT").alias("gt"), V.sample_value(F.col("format_keys"), F.col("genotype"), "PL").alias("pl"))


def variant_types(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "gvcf_records").unionByName(_variants(spark, sf).drop("contig_id", "rest")).groupBy(V.variant_type(F.col("ref_allele"), F.col("alt")).alias("type"), F.size(V.alts(F.col("alt"))).alias("n_alts")).agg(F.count(F.lit(1)).alias("n"))


def split_biallelic(spark: SparkSession, sf: str) -> DataFrame:
    return V.biallelic(_variants(spark, sf)).select("record_id", "alt_index", "alt", "ref_depth", "alt_depth", "pl_ref", "pl_het", "pl_hom")


def trim_alleles(spark: SparkSession, sf: str) -> DataFrame:
    return V.trimmed(V.biallelic(_variants(spark, sf))).select("record_id", "alt_index", "contig_position", "ref_allele", "alt")


def split_primitives(spark: SparkSession, sf: str) -> DataFrame:
    return V.primitives(V.biallelic(_variants(spark, sf))).select("record_id", "alt_index", "contig_position", "ref_allele", "alt")


def merge_sites(spark: SparkSession, sf: str) -> DataFrame:
    return V.merged_sites(_variants(spark, sf))


def rs_id_join(spark: SparkSession, sf: str) -> DataFrame:
    """Known ids of the other calls' records, on GVCF sites and calls."""
    rows = table(spark, sf, "gvcf_records").select((F.col("record_id") + 10_000_000_000).alias("record_id"), "contig_name", "contig_position", "ref_allele", "alt").unionByName(table(spark, sf, "variants").select("record_id", "contig_name", "contig_position", "ref_allele", "alt"))
    return V.with_known_ids(rows, table(spark, sf, "variants")).where("known_ids is not null").select("record_id", "known_ids")


def overlap_flag(spark: SparkSession, sf: str) -> DataFrame:
    flagged = V.with_overlap_flag(table(spark, sf, "gvcf_records"), table(spark, sf, "variants"))
    return flagged.groupBy("sample_name", "in_track").agg(F.count(F.lit(1)).alias("n"))


def gvcf_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return V.reference_blocks(table(spark, sf, "gvcf_records"), table(spark, sf, "contigs"))


def ac_af_an(spark: SparkSession, sf: str) -> DataFrame:
    return A.allele_counts(_calls(spark, sf)).withColumn("af", F.round("af", 6))


def genotype_summary(spark: SparkSession, sf: str) -> DataFrame:
    got = A.genotype_summary(_calls(spark, sf))
    return got.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("gq_mean", "gq_stddev", "inbreeding")})


def hardy_weinberg(spark: SparkSession, sf: str) -> DataFrame:
    return A.with_hardy_weinberg(A.genotype_summary(_calls(spark, sf))).select("contig", "contig_position", "hwp")


def allele_balance(spark: SparkSession, sf: str) -> DataFrame:
    got = A.allele_balance(_calls(spark, sf))
    return got.withColumns({c: F.round(F.col(c) + 1e-9, 5) for c in ("ab_het", "ab_hom", "ond")})


def qd(spark: SparkSession, sf: str) -> DataFrame:
    return A.quality_by_depth(_calls(spark, sf)).withColumn("qd", F.round(F.col("qd") + 1e-9, 5))


def rms_mq(spark: SparkSession, sf: str) -> DataFrame:
    got = A.mapping_quality(_elements(spark, sf))
    return got.select("contig", "position", "depth", F.round("mq", 5).alias("mq"), "mq0", F.round("share_zero", 5).alias("share_zero"), F.round("share_low", 5).alias("share_low"))


def sor(spark: SparkSession, sf: str) -> DataFrame:
    t = tallies.strand_tables(_counts(spark, sf))
    return t.select("contig", "position", "alt", F.round(A.strand_odds(*(F.col(c) for c in ("ref_forward", "ref_reverse", "alt_forward", "alt_reverse"))), 6).alias("sor"))


def fisher_strand(spark: SparkSession, sf: str) -> DataFrame:
    return A.with_strand_bias(tallies.strand_tables(_counts(spark, sf))).select("contig", "position", "alt", F.round("fs", 3).alias("fs"))


def rank_sum_z(spark: SparkSession, sf: str) -> DataFrame:
    els = _elements(spark, sf)
    sites = tallies.strand_tables(_counts(spark, sf)).select("contig", "position", "ref", "alt")
    return A.rank_sums(els, sites).withColumn("z", F.round("z", 6))


def base_shares(spark: SparkSession, sf: str) -> DataFrame:
    got = A.base_shares(tallies.base_counts(_counts(spark, sf)))
    return got.where("share_n > 0 or share_deleted > 0").withColumns({c: F.round(c, 6) for c in ("share_n", "share_deleted")})


_DEC = "dec AS (SELECT *, string_split(rest, chr(9))[1] AS info, string_split(rest, chr(9))[2] AS fk, string_split(rest, chr(9))[3] AS gtx FROM variants)"


def _sv(key: str) -> str:
    return f"(CASE WHEN list_position(string_split(fk, ':'), '{key}') > 0 THEN nullif(nullif(string_split(gtx, ':')[list_position(string_split(fk, ':'), '{key}')], '.'), '') END)"


_ALTS = "CASE WHEN alt IS NULL OR alt = '.' THEN [] ELSE string_split(alt, ',') END"
_BI = f"""{_DEC}, bi0 AS (SELECT *, {_ALTS} AS al, string_split({_sv('AD')}, ',') AS ad, string_split({_sv('PL')}, ',') AS pl FROM dec),
bi AS (SELECT *, al[i + 1] AS one, i + 1 AS a FROM (SELECT *, unnest(range(len(al))) AS i FROM bi0))"""
_SYM = "(one LIKE '<%' OR one = '*')"
_CUT = "CASE WHEN {s} THEN 0 ELSE list_max(list_filter(range(0, greatest(1, least(length({r}), length({a})))), lambda j: {f}({r}, j) = {f}({a}, j))) END"
_GT = f"""{_DEC}, gts AS (SELECT *, {contig_key()} AS contig, list_filter(list_transform(string_split_regex({_sv('GT')}, '[/|]'), lambda x: TRY_CAST(x AS INT)), lambda x: x IS NOT NULL) AS gt, list_transform(string_split({_sv('AD')}, ','), lambda x: TRY_CAST(x AS INT)) AS ad,
    TRY_CAST({_sv('GQ')} AS INT) AS gq, TRY_CAST({_sv('DP')} AS INT) AS dp FROM dec)"""
_STATS = """sites_ AS (SELECT contig, position, ref, alt FROM strands), v AS (SELECT e.contig, e.position, base = alt AS is_alt, qual, map_q, least(read_offset, read_length - 1 - read_offset) AS ed FROM els e JOIN sites_ USING (contig, position) WHERE base = ref OR base = alt),
vv AS (SELECT contig, position, is_alt, 'BaseQRankSum' AS statistic, qual AS value FROM v UNION ALL SELECT contig, position, is_alt, 'MQRankSum', map_q FROM v UNION ALL SELECT contig, position, is_alt, 'ReadPosRankSum', ed FROM v),
rk AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY contig, position, statistic, value) - 1) / 2 AS mid, count(*) OVER (PARTITION BY contig, position, statistic, value) AS tc FROM vv WHERE value IS NOT NULL WINDOW w AS (PARTITION BY contig, position, statistic ORDER BY value)),
ag AS (SELECT contig, position, statistic, count(*) FILTER (WHERE is_alt) AS n_alt, count(*) FILTER (WHERE NOT is_alt) AS n_ref, sum(mid) FILTER (WHERE is_alt) AS w, sum(tc * tc - 1) AS ties FROM rk GROUP BY ALL),
va AS (SELECT *, n_alt * n_ref / 12 * (n_alt + n_ref + 1 - ties / nullif((n_alt + n_ref) * (n_alt + n_ref - 1), 0)) AS var_ FROM ag WHERE n_alt > 0 AND n_ref > 0)"""

QUERIES = {
    f.__name__: f
    for f in (
        variant_decode, variant_types, split_biallelic, trim_alleles, split_primitives, merge_sites, rs_id_join, overlap_flag, gvcf_blocks, ac_af_an, genotype_summary, hardy_weinberg, allele_balance, qd, rms_mq, sor, fisher_strand, rank_sum_z, base_shares,
    )
}

ORACLES = {
    "variant_decode": f"WITH {_DEC} SELECT record_id, regexp_extract(info, '(?:^|;)DP=([^;]*)', 1) AS dp, nullif(regexp_extract(info, '(?:^|;)AF=([^;]*)', 1), '') AS af, CAST(len(list_filter(string_split(info, ';'), lambda x: x <> '' AND x <> '.')) AS INT) AS n_info, {_sv('GT')} AS gt, {_sv('PL')} AS pl FROM dec",
    "variant_types": f"""WITH u AS (SELECT ref_allele, alt FROM gvcf_records UNION ALL SELECT ref_allele, alt FROM variants), t AS (SELECT {_ALTS} AS al, list_distinct(list_transform({_ALTS}, lambda x: CASE WHEN x LIKE '<%' OR x = '*' THEN 'SYMBOLIC' WHEN length(x) <> length(ref_allele) THEN 'INDEL' WHEN length(x) = 1 THEN 'SNP' ELSE 'MNP' END)) AS ks FROM u),
        r AS (SELECT *, list_filter(ks, lambda x: x <> 'SYMBOLIC') AS rl FROM t) SELECT CASE WHEN len(ks) = 0 THEN 'NO_VARIATION' WHEN len(rl) = 0 THEN 'SYMBOLIC' WHEN len(rl) > 1 THEN 'MIXED' ELSE rl[1] END AS type, CAST(len(al) AS INT) AS n_alts, count(*) AS n FROM r GROUP BY 1, 2""",
    "split_biallelic": f"WITH {_BI} SELECT record_id, CAST(i AS INT) AS alt_index, one AS alt, TRY_CAST(ad[1] AS INT) AS ref_depth, TRY_CAST(ad[a + 1] AS INT) AS alt_depth, TRY_CAST(pl[1] AS INT) AS pl_ref, TRY_CAST(pl[CAST(a * (a + 1) / 2 + 1 AS INT)] AS INT) AS pl_het, TRY_CAST(pl[CAST(a * (a + 3) / 2 + 1 AS INT)] AS INT) AS pl_hom FROM bi",
    "trim_alleles": f"""WITH {_BI}, c1 AS (SELECT *, {_CUT.format(s=_SYM, r="ref_allele", a="one", f="right")} AS cut FROM bi), c2 AS (SELECT *, left(ref_allele, length(ref_allele) - cut) AS r2, CASE WHEN {_SYM} THEN one ELSE left(one, length(one) - cut) END AS a2 FROM c1),
        c3 AS (SELECT *, {_CUT.format(s=_SYM, r="r2", a="a2", f="left")} AS skip FROM c2) SELECT record_id, CAST(i AS INT) AS alt_index, CAST(contig_position + skip AS INT) AS contig_position, substr(r2, skip + 1) AS ref_allele, substr(a2, skip + 1) AS alt FROM c3""",
    "split_primitives": f"""WITH {_BI}, s AS (SELECT *, unnest(CASE WHEN length(ref_allele) = length(one) AND NOT {_SYM} THEN list_filter(range(length(ref_allele)), lambda j: substr(ref_allele, j + 1, 1) <> substr(one, j + 1, 1)) ELSE [-1] END) AS st FROM bi)
        SELECT record_id, CAST(i AS INT) AS alt_index, CAST(contig_position + greatest(st, 0) AS INT) AS contig_position, CASE WHEN st < 0 THEN ref_allele ELSE substr(ref_allele, st + 1, 1) END AS ref_allele, CASE WHEN st < 0 THEN one ELSE substr(one, st + 1, 1) END AS alt FROM s""",
    "merge_sites": f"""WITH {_DEC}, k AS (SELECT *, {contig_key()} AS contig FROM dec), st AS (SELECT contig, contig_position, arg_max(ref_allele, ROW(length(ref_allele), ref_allele)) AS ref, count(*) AS n_records, count(DISTINCT sample_name) AS n_samples, max(qual) AS best_qual, CAST(sum(TRY_CAST(nullif(regexp_extract(info, '(?:^|;)DP=([^;]*)', 1), '') AS BIGINT)) AS BIGINT) AS depth,
        coalesce(array_to_string(list_sort(list_distinct(list(variant_id) FILTER (WHERE variant_id <> '.'))), ';'), '') AS ids FROM k GROUP BY ALL), e AS (SELECT DISTINCT k.contig, k.contig_position, ref_allele, unnest({_ALTS}) AS a FROM k),
        x AS (SELECT e.contig, e.contig_position, CASE WHEN a LIKE '<%' OR a = '*' THEN a ELSE a || substr(ref, length(ref_allele) + 1) END AS l FROM e JOIN st ON st.contig IS NOT DISTINCT FROM e.contig AND st.contig_position = e.contig_position),
        g AS (SELECT contig, contig_position, array_to_string(list_sort(list_distinct(list(l))), ',') AS alts FROM x GROUP BY ALL) SELECT st.*, coalesce(alts, '') AS alts FROM st LEFT JOIN g USING (contig, contig_position)""",
    "rs_id_join": f"""WITH u AS (SELECT record_id + 10000000000 AS record_id, contig_name, contig_position, ref_allele, alt FROM gvcf_records UNION ALL SELECT record_id, contig_name, contig_position, ref_allele, alt FROM variants), o AS (SELECT record_id, {contig_key()} AS k, contig_position, ref_allele, unnest({_ALTS}) AS a FROM u),
        t AS (SELECT DISTINCT {contig_key()} AS k, contig_position, ref_allele, unnest({_ALTS}) AS a, variant_id FROM variants WHERE variant_id <> '.') SELECT record_id, array_to_string(list_sort(list_distinct(list(variant_id))), ';') AS known_ids FROM o JOIN t USING (k, contig_position, ref_allele, a) GROUP BY record_id""",
    "overlap_flag": f"WITH p AS (SELECT DISTINCT {contig_key()} AS k, contig_position AS p FROM variants WHERE filters IS NULL OR filters IN ('.', 'PASS')) SELECT sample_name, p.p IS NOT NULL AS in_track, count(*) AS n FROM (SELECT *, {contig_key()} AS gk FROM gvcf_records) g LEFT JOIN p ON p.k = gk AND p.p = contig_position GROUP BY ALL",
    "gvcf_blocks": f"""WITH known AS ({contigs()}), f AS (SELECT *, format_keys AS fk, genotype AS gtx, {contig_key()} AS k, TRY_CAST(regexp_extract(info, '(^|;)END=([0-9]+)(;|$)', 2) AS BIGINT) AS e FROM gvcf_records WHERE alt IN ('<NON_REF>', '.')),
        r AS (SELECT record_id, sample_name, cname AS contig_name, CAST(contig_position AS BIGINT) AS a, CASE WHEN e >= contig_position THEN e ELSE contig_position + length(ref_allele) - 1 END AS b, least(TRY_CAST({_sv('GQ')} AS INT), 99) AS gq, TRY_CAST({_sv('DP')} AS INT) AS dp, coalesce(TRY_CAST({_sv('MIN_DP')} AS INT), TRY_CAST({_sv('DP')} AS INT)) AS mdp,
            list_transform(string_split({_sv('PL')}, ','), lambda x: TRY_CAST(x AS INT)) AS pl FROM f JOIN known ON ckey = k),
        q AS (SELECT *, CASE WHEN gq < 60 THEN greatest(gq, 0) WHEN gq < 70 THEN 60 WHEN gq < 80 THEN 61 WHEN gq < 90 THEN 62 WHEN gq < 99 THEN 63 ELSE 64 END AS band FROM r WHERE gq IS NOT NULL),
        p AS (SELECT *, lag(b) OVER w AS pb, lag(band) OVER w AS pband FROM q WINDOW w AS (PARTITION BY sample_name, contig_name ORDER BY a, record_id)),
        i AS (SELECT *, sum(CASE WHEN pb IS NULL OR a > pb + 1 OR band <> pband THEN 1 ELSE 0 END) OVER (PARTITION BY sample_name, contig_name ORDER BY a, record_id) AS isl FROM p)
        SELECT sample_name, contig_name, min(a) AS from_position, CAST(max(b) AS BIGINT) AS to_position, count(*) AS n_records, list_sort(list(gq))[count(*) // 2 + 1] AS median_gq, list_sort(list(dp) FILTER (WHERE dp IS NOT NULL))[count(dp) // 2 + 1] AS median_dp, min(mdp) AS min_dp, concat_ws(',', min(pl[1]), min(pl[2]), min(pl[3])) AS min_pl FROM i GROUP BY sample_name, contig_name, isl""",
    "ac_af_an": f"""WITH {_GT}, x AS (SELECT contig, contig_position, {_ALTS} AS al, unnest(gt) AS g FROM gts WHERE contig IS NOT NULL), c AS (SELECT contig, contig_position, CASE WHEN g > 0 THEN al[g] END AS allele, count(*) AS ac FROM x GROUP BY ALL), t AS (SELECT contig, contig_position, CAST(sum(ac) AS BIGINT) AS an FROM c GROUP BY ALL)
        SELECT contig, contig_position, allele, ac, an, round(ac / an, 6) AS af FROM c JOIN t USING (contig, contig_position) WHERE allele IS NOT NULL""",
    "genotype_summary": f"""WITH {_GT}, s AS (SELECT contig, contig_position, count(*) FILTER (WHERE len(gt) = 2 AND gt[1] = 0 AND gt[2] = 0) AS hom_ref, count(*) FILTER (WHERE len(gt) = 2 AND gt[1] <> gt[2]) AS het, count(*) FILTER (WHERE len(gt) = 2 AND gt[1] = gt[2] AND gt[1] > 0) AS hom_alt, count(*) FILTER (WHERE coalesce(len(gt), 0) = 0) AS no_calls,
        CAST(sum(CASE WHEN len(gt) > 0 THEN len(gt) END) AS BIGINT) AS called_chromosomes, round(avg(gq) + 1e-9, 6) AS gq_mean, round(stddev_samp(gq) + 1e-9, 6) AS gq_stddev, CAST(sum(dp) AS BIGINT) AS depth FROM gts WHERE contig IS NOT NULL GROUP BY ALL), n AS (SELECT *, hom_ref + het + hom_alt AS n, (2 * hom_ref + het) / (2 * (hom_ref + het + hom_alt)) AS p FROM s)
        SELECT contig, contig_position, hom_ref, het, hom_alt, no_calls, called_chromosomes, gq_mean, gq_stddev, depth, CASE WHEN n >= 10 AND 2 * p * (1 - p) * n > 0 THEN round(1 - het / (2 * p * (1 - p) * n) + 1e-9, 6) END AS inbreeding FROM n""",
    "allele_balance": f"""WITH {_GT}, b AS (SELECT contig, contig_position, gt[1] <> gt[2] AS het, ad[gt[1] + 1] AS a, ad[gt[2] + 1] AS b, list_sum(list_transform(ad, lambda x: coalesce(x, 0))) AS t FROM gts WHERE contig IS NOT NULL AND len(gt) = 2 AND ad IS NOT NULL)
        SELECT contig, contig_position, round(avg(CASE WHEN het AND a + b > 0 THEN a / (a + b) END) + 1e-9, 5) AS ab_het, round(avg(CASE WHEN NOT het THEN a / t END) + 1e-9, 5) AS ab_hom, round(avg((t - CASE WHEN het THEN a + b ELSE a END) / t) + 1e-9, 5) AS ond FROM b WHERE t > 0 AND a IS NOT NULL AND b IS NOT NULL GROUP BY ALL""",
    "qd": f"WITH {_GT} SELECT record_id, round(qual / dp + 1e-9, 5) AS qd FROM gts WHERE len(list_filter(gt, lambda x: x > 0)) > 0 AND qual IS NOT NULL AND dp > 0",
    "rms_mq": f"WITH {_ELEMENTS} SELECT contig, position, count(*) AS depth, round(sqrt(avg(map_q * map_q)), 5) AS mq, count(*) FILTER (WHERE map_q = 0) AS mq0, round(count(*) FILTER (WHERE map_q = 0) / count(*), 5) AS share_zero, round(count(*) FILTER (WHERE map_q <= 10) / count(*), 5) AS share_low FROM els WHERE map_q IS NOT NULL AND map_q <> 255 AND NOT is_deletion GROUP BY contig, position",
    "sor": f"""WITH {_ELEMENTS}, {_CONSENSUS}, {_STRANDS}, o AS (SELECT contig, position, alt, ref_forward + 1.0 AS a, ref_reverse + 1.0 AS b, alt_forward + 1.0 AS c, alt_reverse + 1.0 AS d FROM strands)
        SELECT contig, position, alt, round(ln(a * d / (b * c) + b * c / (a * d)) + ln(least(a, b) / greatest(a, b)) - ln(least(c, d) / greatest(c, d)), 6) AS sor FROM o""",
    "rank_sum_z": f"WITH {_ELEMENTS}, {_CONSENSUS}, {_STRANDS}, {_STATS} SELECT contig, position, statistic, n_ref, n_alt, CASE WHEN var_ > 0 THEN round((w - n_alt * (n_alt + 1) / 2 - n_alt * n_ref / 2) / sqrt(var_), 6) END AS z FROM va",
    "base_shares": f"""WITH {_ELEMENTS}, c AS (SELECT contig, position, count(*) FILTER (WHERE base = 'N') AS n, count(*) FILTER (WHERE base IN ('A', 'C', 'G', 'T')) AS k, count(*) FILTER (WHERE is_deletion) AS d, count(*) AS t FROM els GROUP BY ALL) SELECT contig, position, round(n / (n + k + 1), 6) AS share_n, round(d / t, 6) AS share_deleted FROM c WHERE n > 0 OR d > 0""",
}
