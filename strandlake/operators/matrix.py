"""Read by allele likelihoods as a long table (site keys, read, allele, ll): normalising, choosing, filtering and reshaping by aggregates.

A site's reads are never gathered; what a read says is an aggregate over its alleles, of which there are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.pileup import LOCUS

#: How far alleles may lie under a read's best, what makes a read informative, and the error per base of a modelled read.
CAP, INFORMATIVE, ERROR_PER_BASE = 4.5, 0.2, 0.02
READ = [*LOCUS, "record_id"]


def from_elements(els: DataFrame, sites: DataFrame) -> DataFrame:
    """Likelihood of each element's base for the reference and the alternate of its site (contig, position, ref, alt)."""
    used = els.where("base in ('A', 'C', 'G', 'T') and qual is not null").join(sites.select(*LOCUS, "ref", "alt"), LOCUS)
    e = F.pow(F.lit(10.0), F.greatest("qual", F.lit(1)) / -10.0)
    of = lambda a: F.log10(F.when(F.col("base") == F.col(a), 1 - e).otherwise(e / 3))
    return used.select("sample", *READ, F.inline(F.array(*(F.struct(F.col(a).alias("allele"), F.lit(a == "ref").alias("is_ref"), of(a).alias("ll")) for a in ("ref", "alt")))))


def normalized(rows: DataFrame, cap: float = CAP, best_is_zero: bool = True) -> DataFrame:
    """No allele further under the read's best than the cap; the best moved to 0 if asked."""
    best = rows.groupBy("sample", *READ).agg(F.max("ll").alias("_best"))
    joined = rows.join(best, [rows["sample"].eqNullSafe(best["sample"]), *(rows[c] == best[c] for c in READ)]).select(rows["*"], "_best")
    lifted = F.greatest(F.col("ll"), F.col("_best") - cap)
    return joined.withColumn("ll", lifted - F.col("_best") if best_is_zero else lifted).drop("_best")


def marginalized(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The best likelihood over the old alleles of each new one; groups: (allele, new_allele)."""
    joined = rows.join(groups, "allele")
    return joined.groupBy("sample", *READ, F.col("new_allele").alias("allele")).agg(F.max("ll").alias("ll"))


def best_alleles(rows: DataFrame, informative: float = INFORMATIVE) -> DataFrame:
    """The likeliest allele of each read (the first of equals), its lead over the next, and whether that tells something."""
    ranked = rows.groupBy("sample", *READ).agg(F.sort_array(F.collect_list(F.struct((-F.col("ll")).alias("l"), "allele"))).alias("r"))  # a read has few alleles
    lead = F.when(F.size("r") > 1, F.get("r", F.lit(1))["l"] - F.col("r")[0]["l"])
    return ranked.select("sample", *READ, F.col("r")[0]["allele"].alias("allele"), lead.alias("lead"), (lead > informative).alias("informative"))


def well_modelled(rows: DataFrame, lengths: DataFrame, per_base: float = ERROR_PER_BASE, per_error: float = -4.0) -> DataFrame:
    """Without reads whose best likelihood lies under what ``per_base`` errors of a read of their length (record_id, read_length) would give."""
    best = rows.groupBy(*READ).agg(F.max("ll").alias("_best")).join(lengths, "record_id")
    kept = best.where(F.col("_best") >= F.least(F.lit(2.0), F.ceil(F.col("read_length") * per_base)) * per_error).select(*READ)
    return rows.join(kept, READ, "left_semi")


def with_non_ref(rows: DataFrame, name: str = "<NON_REF>") -> DataFrame:
    """With a row for any other allele: the read's worst likelihood, as no allele in the table speaks for it."""
    other = rows.groupBy("sample", *READ).agg(F.min("ll").alias("ll"))
    return rows.select("sample", *READ, "allele", "ll").unionByName(other.withColumn("allele", F.lit(name)).select("sample", *READ, "allele", "ll"))


def reads_by_allele(best: DataFrame) -> DataFrame:
    """Informative reads per allele and sample: the depth that annotations count."""
    return best.where("informative").groupBy("sample", *LOCUS, "allele").agg(F.count(F.lit(1)).alias("depth"))


def covering(rows: DataFrame, spans: DataFrame, margin: int = 0) -> DataFrame:
    """Rows of reads (spans: record_id, from_position, to_position) that cover their site and ``margin`` positions on both sides."""
    span = spans.select("record_id", F.col("from_position").alias("_a"), F.col("to_position").alias("_b"))
    return rows.join(span, "record_id").where((F.col("position") - margin >= F.col("_a")) & (F.col("position") + margin <= F.col("_b"))).drop("_a", "_b")


def with_changed_reads(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows under the reads' new ids (ids: record_id, new_id); reads without one keep theirs."""
    renamed = rows.join(ids.select(F.col("record_id").alias("_old"), "new_id"), F.col("record_id") == F.col("_old"), "left")
    return renamed.withColumn("record_id", F.coalesce("new_id", "record_id")).drop("_old", "new_id")


def with_added_reads(rows: DataFrame, reads: DataFrame, value: float) -> DataFrame:
    """With rows of further reads (sample, contig, position, record_id): ``value`` for each allele that the sample has at the site."""
    alleles = rows.select(F.col("sample").alias("_s"), F.col("contig").alias("_c"), F.col("position").alias("_p"), "allele").distinct()
    more = reads.join(alleles, F.col("sample").eqNullSafe(F.col("_s")) & (F.col("contig") == F.col("_c")) & (F.col("position") == F.col("_p")))
    return rows.select("sample", *READ, "allele", "ll").unionByName(more.select("sample", *READ, "allele", F.lit(float(value)).alias("ll")))


def per_read(rows: DataFrame) -> DataFrame:
    """One row per read and site with ``lls``, a map of its alleles to likelihoods."""
    return rows.groupBy("sample", *READ).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("allele", "ll")))).alias("lls"))  # a read has few alleles


def best_diploid(rows: DataFrame) -> DataFrame:
    """(sample, contig, position, ll_ref, ll_het, ll_alt, best, n) of the three allele pairs of a biallelic site (rows with ``is_ref``): each read speaks for either allele of a pair with the same chance."""
    per = rows.groupBy("sample", *READ).agg(F.max(F.when(F.col("is_ref"), F.col("ll"))).alias("a"), F.max(F.when(~F.col("is_ref"), F.col("ll"))).alias("b"))
    top = F.greatest("a", "b")
    het = top + F.log10((F.pow(F.lit(10.0), F.col("a") - top) + F.pow(F.lit(10.0), F.col("b") - top)) / 2)
    sums = per.groupBy("sample", *LOCUS).agg(F.sum("a").alias("ll_ref"), F.sum(het).alias("ll_het"), F.sum("b").alias("ll_alt"), F.count(F.lit(1)).alias("n"))
    best = F.when((F.col("ll_ref") >= F.col("ll_het")) & (F.col("ll_ref") >= F.col("ll_alt")), "0/0").when(F.col("ll_het") >= F.col("ll_alt"), "0/1").otherwise("1/1")
    return sums.withColumn("best", best)
