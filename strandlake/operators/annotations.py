"""Annotations of variant sites, as aggregates over genotypes or pileup elements.

Rank sums come from histograms: per site and allele the values (qualities, positions) have a bounded range, so ranks are running sums
over value counts and no site's reads are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.kernels import maths
from strandlake.operators import walks
from strandlake.operators.pileup import LOCUS
from strandlake.operators.variants import alts, sample_value
from strandlake.tables import contig_key

SITE = ["contig", "contig_position"]


def genotypes(rows: DataFrame) -> DataFrame:
    """Decoded records with contig, gt (array of allele indices, null for no-call), ad, gq and depth."""
    value = lambda key: sample_value(F.col("format_keys"), F.col("genotype"), key)
    gt = F.transform(F.split(value("GT"), r"[/|]"), lambda x: x.try_cast("int"))
    return rows.withColumns({"contig": contig_key(F.col("contig_name")), "gt": F.filter(gt, lambda x: x.isNotNull()), "ad": F.transform(F.split(value("AD"), ","), lambda x: x.try_cast("int")), "gq": value("GQ").try_cast("int"), "dp": value("DP").try_cast("int")})


def allele_counts(calls: DataFrame) -> DataFrame:
    """AN per site, and AC and AF of every alternate base string: (contig, contig_position, allele, ac, an, af)."""
    called = calls.where("contig is not null and size(gt) > 0").select(*SITE, "ref_allele", "alt", F.explode("gt").alias("g"))
    allele = F.when(F.col("g") == 0, F.lit(None).cast("string")).otherwise(F.get(alts(F.col("alt")), F.col("g") - 1))
    counted = called.select(*SITE, allele.alias("allele")).groupBy(*SITE, "allele").agg(F.count(F.lit(1)).alias("ac"))
    total = counted.groupBy(*SITE).agg(F.sum("ac").alias("an"))
    return counted.where("allele is not null").join(total, SITE).withColumn("af", F.col("ac") / F.col("an"))


def genotype_summary(calls: DataFrame) -> DataFrame:
    """Counts of hom-ref, het and hom-alt genotypes, calls and no-calls, mean and deviation of GQ, inbreeding coefficient (10 calls or more), per site."""
    diploid = F.size("gt") == 2
    het = diploid & (F.col("gt")[0] != F.col("gt")[1])
    ref = diploid & (F.col("gt")[0] == 0) & (F.col("gt")[1] == 0)
    per = calls.where("contig is not null").groupBy(*SITE).agg(
        F.count_if(ref).alias("hom_ref"), F.count_if(het).alias("het"), F.count_if(diploid & ~het & ~ref).alias("hom_alt"), F.count_if(F.coalesce(F.size("gt"), F.lit(0)) <= 0).alias("no_calls"), F.sum(F.when(F.size("gt") > 0, F.size("gt"))).alias("called_chromosomes"), F.avg("gq").alias("gq_mean"), F.stddev("gq").alias("gq_stddev"), F.sum("dp").alias("depth"),
    )
    n = F.col("hom_ref") + F.col("het") + F.col("hom_alt")
    p = F.try_divide(2 * F.col("hom_ref") + F.col("het"), 2 * n)
    expected = 2 * p * (1 - p) * n
    return per.withColumn("inbreeding", F.when((n >= 10) & (expected > 0), 1 - F.try_divide(F.col("het"), expected)))


def with_hardy_weinberg(summary: DataFrame) -> DataFrame:
    @F.pandas_udf("double")
    def p_value(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([maths.hardy_weinberg_p(int(x), int(y), int(z)) for x, y, z in zip(a, b, c, strict=True)], dtype=float)

    return summary.withColumn("hwp", p_value("hom_ref", "het", "hom_alt"))


def allele_balance(calls: DataFrame) -> DataFrame:
    """Share of reference reads among het (ab_het) and of the called allele among hom (ab_hom) genotypes' reads, and of reads of other alleles (ond)."""
    two = F.size("gt") == 2
    total = F.aggregate("ad", F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    a, b = F.get("ad", F.col("gt")[0]), F.get("ad", F.col("gt")[1])
    rows = calls.where(F.col("contig").isNotNull() & two & F.col("ad").isNotNull()).withColumns({"_t": total, "_a": a, "_b": b, "_het": F.col("gt")[0] != F.col("gt")[1]}).where("_t > 0 and _a is not null and _b is not null")
    hets, homs = F.when(F.col("_het") & (F.col("_a") + F.col("_b") > 0), F.col("_a") / (F.col("_a") + F.col("_b"))), F.when(~F.col("_het"), F.col("_a") / F.col("_t"))
    rest = (F.col("_t") - F.when(F.col("_het"), F.col("_a") + F.col("_b")).otherwise(F.col("_a"))) / F.col("_t")
    return rows.groupBy(*SITE).agg(F.avg(hets).alias("ab_het"), F.avg(homs).alias("ab_hom"), F.avg(rest).alias("ond"))


def allele_balance_by_sample(calls: DataFrame) -> DataFrame:
    """(record_id, sample_name, ab): the reference's share of the two alleles' reads, per heterozygous record with one reference allele."""
    het = calls.where((F.size("gt") == 2) & (F.array_min("gt") == 0) & (F.array_max("gt") > 0))
    a, b = F.get("ad", F.lit(0)), F.get("ad", F.array_max("gt"))
    return het.where((a + b) > 0).select("record_id", "sample_name", (a / (a + b)).alias("ab"))


def strand_bias_by_sample(els: DataFrame, sites: DataFrame) -> DataFrame:
    """The four strand counts of each sample at ``sites`` (contig, position, ref, alt)."""
    rows = els.join(sites.select(*LOCUS, "ref", "alt"), LOCUS)
    n = lambda allele, reverse: F.count_if((F.col("base") == F.col(allele)) & (F.col("is_reverse") == F.lit(reverse))).alias(f"{allele}_{'reverse' if reverse else 'forward'}")
    return rows.groupBy("sample", *LOCUS).agg(*(n(a, r) for a in ("ref", "alt") for r in (False, True)))


_SAMPLE_TABLES = "sample string, contig string, position bigint, ref_forward bigint, ref_reverse bigint, alt_forward bigint, alt_reverse bigint, depth bigint, mq0 bigint"


def _sample_tables_of(bins: walks.Bins) -> Iterator[pa.RecordBatch]:
    keys, counts = walks.base_counts(bins)
    ref = counts.argmax(axis=1)
    counts[np.arange(len(keys)), ref] = 0
    some = counts.any(axis=1)
    keys, ref, alt = keys[some], ref[some], counts[some].argmax(axis=1)
    total, names = None, {}
    for b in bins.blocks():
        coded = b.rows.column("sample").dictionary_encode(null_encoding="encode")
        codes = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        site, there = walks.placed_among(keys, b.key)
        at, site = np.flatnonzero(there), site[there]
        read, base, strand = b.read[at], b.base[at], b.strand[b.read[at]]
        marks = [base == x[site] for x in (ref, alt)]
        marks = [m & (strand == s) for m in marks for s in (0, 1)] + [~b.deletion[at], b.map_q[read] == 0, np.ones(len(at), bool)]
        cells = [np.flatnonzero(m) for m in marks]
        own = (site << 32) + codes[read]
        total = walks.added(total, np.concatenate([own[x] for x in cells]), np.repeat(np.arange(len(cells)), [len(x) for x in cells]), len(cells))
    own, counts = total
    if len(own):
        sample = pa.array(list(names), pa.string()).take(pa.array(own & 0xFFFFFFFF))
        yield pa.RecordBatch.from_arrays([sample, *bins.locus(keys[own >> 32]), *(pa.array(np.ascontiguousarray(counts[:, i])) for i in range(6))], names=[x.split()[0] for x in _SAMPLE_TABLES.split(", ")])


def sample_tables(rows: DataFrame) -> DataFrame:
    """Strand counts, depth and reads of mapping quality 0 of each sample where a base differs from the consensus, for placed reads (``pileup.read_rows``), from one exchange of them."""
    return walks.walked(rows, {"sample": F.col("sample")}, _sample_tables_of, _SAMPLE_TABLES)


def mapping_quality_zero_by_sample(els: DataFrame) -> DataFrame:
    """(sample, contig, position, mq0) where a sample has reads of mapping quality 0."""
    return els.where("map_q = 0").groupBy("sample", *LOCUS).agg(F.count(F.lit(1)).alias("mq0"))


def quality_by_depth(calls: DataFrame) -> DataFrame:
    """QUAL over the depth of the record's variant sample, per record."""
    variant = F.exists("gt", lambda g: g > 0)
    return calls.where(variant & F.col("qual").isNotNull() & (F.col("dp") > 0)).select("record_id", (F.col("qual") / F.col("dp")).alias("qd"))


def mapping_quality(els: DataFrame) -> DataFrame:
    """Per position: rms of mapping qualities, how many are 0, and the shares of 0 and of 10 or less. 255 is no quality."""
    known = els.where("map_q is not null and map_q <> 255 and not is_deletion")
    n = F.count(F.lit(1))
    return known.groupBy(*LOCUS).agg(n.alias("depth"), F.sqrt(F.sum(F.col("map_q").cast("bigint") * F.col("map_q")) / n).alias("mq"), F.count_if(F.col("map_q") == 0).alias("mq0"), (F.count_if(F.col("map_q") == 0) / n).alias("share_zero"), (F.count_if(F.col("map_q") <= 10) / n).alias("share_low"))


def strand_odds(rf: Column, rr: Column, af: Column, ar: Column) -> Column:
    """Natural log of the symmetric odds ratio with one added to each cell, scaled by the alleles' balance."""
    a, b, c, d = (x.cast("double") + 1 for x in (rf, rr, af, ar))
    ratio = (a * d) / (b * c)
    return F.log(ratio + 1 / ratio) + F.log(F.least(a, b) / F.greatest(a, b)) - F.log(F.least(c, d) / F.greatest(c, d))


def with_strand_bias(tables: DataFrame, min_total: int = 2) -> DataFrame:
    """Strand tables of more than ``min_total`` reads with SOR and phred-scaled Fisher p."""

    @F.pandas_udf("double")
    def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([maths.fisher_two_sided(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d, strict=True)], dtype=float)

    cells = ["ref_forward", "ref_reverse", "alt_forward", "alt_reverse"]
    kept = tables.where(sum((F.col(c) for c in cells), F.lit(0)) > min_total)
    return kept.withColumns({"sor": strand_odds(*(F.col(c) for c in cells)), "fs": F.abs(-10 * F.log10(F.greatest(fisher(*cells), F.lit(1e-320))))})


def rank_sum_z(values: DataFrame, keys: list[str], is_alt: str, value: str) -> DataFrame:
    """(keys, n_ref, n_alt, z): the Mann-Whitney z of alternate against reference values, mid-ranks and tie-corrected; null where undefined."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(is_alt).alias("a"), F.count_if(~F.col(is_alt)).alias("r"))
    order = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    both = F.col("a") + F.col("r")
    ranked = counts.withColumn("_mid", F.coalesce(F.sum(both).over(order), F.lit(0)) + (both + 1) / 2)
    per = ranked.groupBy(*keys).agg(F.sum("a").alias("n_alt"), F.sum("r").alias("n_ref"), F.sum(F.col("a") * F.col("_mid")).alias("_w"), F.sum((both * both * both - both).cast("double")).alias("_ties"))
    n, m = F.col("n_alt"), F.col("n_ref")
    size = n + m
    u = F.col("_w") - n * (n + 1) / 2
    variance = n * m / 12 * (size + 1 - F.col("_ties") / F.nullif(size * (size - 1), F.lit(0)))
    return per.where("n_alt > 0 and n_ref > 0").select(*keys, "n_ref", "n_alt", F.when(variance > 0, (u - n * m / 2) / F.sqrt(variance)).alias("z"))


def rank_sums(els: DataFrame, sites: DataFrame) -> DataFrame:
    """Base quality, mapping quality and read position rank sums at ``sites`` (contig, position, ref, alt); hard-clipped bases too where ``els`` has ``hard_clipped``."""
    rows = els.join(sites, LOCUS).where((F.col("base") == F.col("ref")) | (F.col("base") == F.col("alt")))
    rows = rows.withColumns({"is_alt": F.col("base") == F.col("alt"), "end_distance": F.least(F.col("read_offset"), F.col("read_length") - 1 - F.col("read_offset"))})
    statistics = [("BaseQRankSum", "qual"), ("MQRankSum", "map_q"), ("ReadPosRankSum", "end_distance"), *([("ClippingRankSum", "hard_clipped")] if "hard_clipped" in els.columns else [])]
    named = F.array(*(F.struct(F.lit(n).alias("statistic"), F.col(c).cast("bigint").alias("value")) for n, c in statistics))
    return rank_sum_z(rows.select(*LOCUS, "is_alt", F.inline(named)), [*LOCUS, "statistic"], "is_alt", "value")


def base_shares(counts: DataFrame) -> DataFrame:
    """Share of N bases and of deletions per position."""
    known = F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")
    return counts.select(*LOCUS, (F.col("n_n") / (F.col("n_n") + known + 1)).alias("share_n"), F.when(F.col("depth") + F.col("deletions") > 0, F.col("deletions") / (F.col("depth") + F.col("deletions"))).alias("share_deleted"))
