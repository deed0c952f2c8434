"""Queries on compact forms, even thinning, indels against their reference, walks along CIGARs, and distribution functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import bases as B
from strandlake.functions import cigar as C
from strandlake.functions import quality as Q
from strandlake.kernels import maths
from strandlake.kernels import reads as R
from strandlake.operators import compact, matrix, reference
from strandlake.queries.joins import _ROWS, _matrix
from strandlake.queries.pileups import _consensus
from strandlake.session import staged
from strandlake.tables import table, with_contig


def record_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Reads packed and expanded again: bytes of the packed sequence, and whether all came back."""
    reads = table(spark, sf, "reads").select("record_id", "seq", "base_quals")
    packed = compact.compacted(reads)
    back = compact.expanded(packed).withColumnsRenamed({"seq": "_s", "base_quals": "_q"})
    joined = packed.select("record_id", F.length("packed_seq").alias("bytes")).join(back, "record_id").join(reads, "record_id")
    return joined.select("record_id", "bytes", F.col("_s").eqNullSafe(F.upper("seq")).alias("seq_back"), F.col("_q").eqNullSafe(F.col("base_quals")).alias("quals_back"))


def levelled_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Reads per thousand positions of each contig spelling, cut to six by levelling the stacks of equal starts."""
    rows = table(spark, sf, "reads").where("contig_position >= 1").withColumn("window", F.expr("contig_position div 1000"))
    kept = compact.levelled(rows.select("record_id", "contig_name", "window", "contig_position"), ["contig_name", "window"], "contig_position", 6)
    before = rows.groupBy("contig_name", "window").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("contig_position").alias("stacks"))
    after = kept.groupBy(F.col("contig_name").alias("_c"), F.col("window").alias("_w")).agg(F.count(F.lit(1)).alias("kept"))
    return before.join(after, F.col("contig_name").eqNullSafe(F.col("_c")) & (F.col("window") == F.col("_w"))).drop("_c", "_w")


def contamination_removal(spark: SparkSession, sf: str) -> DataFrame:
    """Reads to take away per site and sample so that a quarter goes, from counts by best allele: their sum, which the balance doesn't change."""
    counts = matrix.reads_by_allele(matrix.best_alleles(_matrix(spark, sf))).withColumnRenamed("depth", "n")
    got = compact.balanced_removal(counts, ["sample", "contig", "position"], 0.25)
    return got.groupBy("sample", "contig", "position").agg(F.sum("n").alias("n"), F.sum("removed").alias("removed"), F.count(F.lit(1)).alias("alleles"))


def _records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    refs = staged(reference.slices(_consensus(spark, sf)), "reference-slices")
    rows = with_contig(table(spark, sf, "variants"), table(spark, sf, "contigs"), "contig_name", "contig_id", out="contig").where("contig is not null")
    return compact.one_alternate(rows), refs


def left_aligned_indels(spark: SparkSession, sf: str) -> DataFrame:
    return compact.left_aligned(*_records(spark, sf)).select("record_id", "contig_position", "ref_allele", "alt")


def tandem_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return compact.tandem_repeats(*_records(spark, sf))


def cigar_walks(spark: SparkSession, sf: str) -> DataFrame:
    """CIGARs by base, without empty and trailing operations, as walked twice (a read laid on a haplotype that lies on the reference as the read does) and cut to 30 reference bases."""

    @F.pandas_udf("struct<per_base:string,cleaned:string,trimmed:int,composed:int>")
    def walked(cigars: pd.Series) -> pd.DataFrame:
        rows = []
        for c in cigars:
            ops = R.parse(c)
            n = R.reference_length(ops)
            trimmed = R.trimmed_to_reference(ops, 5, min(34, n - 1)) if n > 5 else []
            plain = [(op, k) for op, k in ops if op in "MID"]
            whole = [("M", R.read_length(plain))]
            rows.append(("".join(R.columns(ops)), "".join(f"{k}{op}" for op, k in R.cleaned(ops)), R.reference_length(trimmed), R.reference_length(R.composed(whole, plain)) if plain and plain[0][0] == plain[-1][0] == "M" else None))
        return pd.DataFrame(rows, columns=["per_base", "cleaned", "trimmed", "composed"]).astype({"composed": "Int64"})

    rows = table(spark, sf, "reads").where(C.has_cigar(F.col("cigar")))
    return rows.select("record_id", walked("cigar").alias("w")).select("record_id", "w.per_base", "w.trimmed", "w.composed")


def distribution_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Of each mapping quality n and its third k: log-gamma, binomial and multinomial chances, a rank-sum count, priors and vectors."""

    @F.pandas_udf("struct<log10_gamma:double,binomial:double,cumulative:double,multinomial:double,dirichlet:double,u_exact:double,prior:double>")
    def values(n: pd.Series, k: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(n.astype(int), k.astype(int), strict=True):
            u = maths.u_counts(min(a, 6), min(b + 1, 4))
            rows.append((maths.log10_gamma(a + 1), maths.log10_binomial(a, b, -0.5), maths.binomial_cumulative(a, 0, b), maths.multinomial([b, a - b], [0.25, 0.75]), maths.dirichlet_multinomial([1.0, 1.0], [b, a - b]), float(u.sum()), float(maths.log10_priors(4, 0.001)[1])))
        return pd.DataFrame(rows, columns=["log10_gamma", "binomial", "cumulative", "multinomial", "dirichlet", "u_exact", "prior"])

    rows = table(spark, sf, "reads").where("map_q is not null").select(F.col("map_q").alias("n"), F.expr("map_q div 3").cast("int").alias("k")).distinct()
    got = rows.withColumn("v", values("n", "k"))
    vectors = F.array(F.col("n").cast("double"), F.lit(2.0), F.lit(1.0)), F.array(F.col("k").cast("double"), F.lit(-1.0), F.lit(0.5))
    added, taken = Q.added(*vectors), Q.added(vectors[0], vectors[1], -1.0)
    return got.select(
        "n", "k", *(F.round(f"v.{c}", 8).alias(c) for c in ("log10_gamma", "binomial", "cumulative", "multinomial", "dirichlet", "u_exact", "prior")), F.round(Q.dot(*vectors), 6).alias("dot"), F.round(added[0], 6).alias("first_sum"), F.round(taken[0], 6).alias("first_difference"),
        F.round(F.aggregate(Q.normalized_log10(F.array(-F.col("n") / 10.0, F.lit(-1.0))), F.lit(0.0), lambda s, x: s + x), 9).alias("normalized"), F.round(Q.scaled_correct_rate(F.col("n") / 300.0), 6).alias("correct_rate"), Q.rounded(F.col("n") / 4.0 - 5).alias("rounded"),
        F.round(Q.log10_sum_by_table(-F.col("n") / 10.0, F.lit(-1.0)), 3).alias("table_sum"), F.array_join(Q.log10_spaced(1, 100, 5).cast("array<string>"), ",").alias("spaced"),
    )


def repeated_substrings(spark: SparkSession, sf: str) -> DataFrame:
    """Of each read's first eight bases: the shortest unit that they are made of, and whether bases match whatever their case."""
    rows = table(spark, sf, "reads").where("length(seq) >= 8")
    return rows.select("record_id", F.left(F.upper("seq"), B.smallest_period(F.upper(F.left("seq", F.lit(8))))).alias("unit"), B.bases_equal(F.substring("seq", 1, 1), F.lower(F.substring("seq", 2, 1))).alias("same"))


_PRIOR = "round(log10(0.001), 8)"
_TABLED = "greatest(-n / 10.0, -1.0) + CASE WHEN abs(-n / 10.0 + 1.0) >= 8 THEN 0 ELSE log10(1 + pow(10, -abs(-n / 10.0 + 1.0))) END"
QUERIES = {f.__name__: f for f in (record_codec, levelled_reads, contamination_removal, left_aligned_indels, tandem_repeats, cigar_walks, distribution_functions, repeated_substrings)}

_LG = "lgamma({x}) / ln(10)"


def _choose(n: str, k: str) -> str:
    return f"({_LG.format(x=f'{n} + 1.0')} - {_LG.format(x=f'{k} + 1.0')} - {_LG.format(x=f'{n} - {k} + 1.0')})"


ORACLES = {
    "record_codec": "SELECT record_id, CAST(8 + 5 * length(regexp_replace(upper(seq), '[ACGT]', '', 'g')) + (length(seq) + 3) // 4 AS INT) AS bytes, TRUE AS seq_back, TRUE AS quals_back FROM reads",
    "levelled_reads": """WITH r AS (SELECT *, contig_position // 1000 AS w FROM reads WHERE contig_position >= 1) SELECT contig_name, CAST(w AS INT) AS window, count(*) AS n, count(DISTINCT contig_position) AS stacks, greatest(least(count(*), 6), count(DISTINCT contig_position)) AS kept FROM r GROUP BY contig_name, w""",
    "contamination_removal": f"WITH {_ROWS}, b AS (SELECT sample, contig, position, allele, count(*) AS n FROM mb WHERE ll = bl AND bl - wl > 0.2 GROUP BY ALL) SELECT sample, contig, position, CAST(sum(n) AS BIGINT) AS n, CAST(floor(sum(n) * 0.25) AS BIGINT) AS removed, count(*) AS alleles FROM b GROUP BY ALL",
    "cigar_walks": r"""WITH p AS (SELECT record_id, cigar, CAST(regexp_extract_all(cigar, '(\d+)[MIDNSHP=X]', 1) AS BIGINT[]) AS l, regexp_extract_all(cigar, '\d+([MIDNSHP=X])', 1) AS o FROM reads WHERE cigar <> '*' AND cigar <> ''), q AS (SELECT *, coalesce(list_sum(list_transform(range(1, len(o) + 1), lambda i: CASE WHEN o[i] IN ('M', 'D', 'N', '=', 'X') THEN l[i] ELSE 0 END)), 0) AS n,
        list_filter(range(1, len(o) + 1), lambda i: o[i] IN ('M', 'I', 'D')) AS pi FROM p) SELECT record_id, array_to_string(list_transform(range(1, len(o) + 1), lambda i: repeat(o[i], CAST(l[i] AS BIGINT))), '') AS per_base, CAST(CASE WHEN n > 5 THEN least(34, n - 1) - 4 ELSE 0 END AS INT) AS trimmed,
        CAST(CASE WHEN len(pi) > 0 AND o[pi[1]] = 'M' AND o[pi[len(pi)]] = 'M' THEN list_sum(list_transform(pi, lambda i: CASE WHEN o[i] IN ('M', 'D') THEN l[i] ELSE 0 END)) END AS INT) AS composed FROM q""",
    "distribution_functions": f"""WITH d AS (SELECT DISTINCT map_q AS n, map_q // 3 AS k FROM reads WHERE map_q IS NOT NULL) SELECT n, CAST(k AS INT) AS k, round({_LG.format(x='n + 1.0')}, 8) AS log10_gamma, round({_choose('n', 'k')} + k * -0.5 + (n - k) * log10(1 - pow(10, -0.5)), 8) AS binomial,
        round(list_sum(list_transform(range(0, CAST(k + 1 AS BIGINT)), lambda i: pow(10, {_choose('n', 'i')} + n * log10(0.5)))), 8) AS cumulative, round(pow(10, {_choose('n', 'k')} + k * log10(0.25) + (n - k) * log10(0.75)), 8) AS multinomial, round(1 / (n + 1.0), 8) AS dirichlet,
        round(pow(10, {_choose('(least(n, 6) + least(k + 1, 4))', 'least(k + 1, 4)')}), 8) AS u_exact, {_PRIOR} AS prior, round(n * k - 2.0 + 0.5, 6) AS dot, CAST(n + k AS DOUBLE) AS first_sum, CAST(n - k AS DOUBLE) AS first_difference, 1.0 AS normalized, round(abs(-10 * log10(greatest(1 - n / 300.0, 1e-300))), 6) AS correct_rate,
        CAST(sign(n / 4.0 - 5) * floor(abs(n / 4.0 - 5) + 0.5) AS INT) AS rounded, round({_TABLED}, 3) AS table_sum, '1,3,10,32,100' AS spaced FROM d""",
    "repeated_substrings": "SELECT record_id, CASE WHEN repeat(left(s, 1), 8) = s THEN left(s, 1) WHEN repeat(left(s, 2), 4) = s THEN left(s, 2) WHEN repeat(left(s, 4), 2) = s THEN left(s, 4) ELSE s END AS unit, upper(substr(seq, 1, 1)) = upper(substr(seq, 2, 1)) AS same FROM (SELECT *, upper(left(seq, 8)) AS s FROM reads WHERE length(seq) >= 8)",
}
