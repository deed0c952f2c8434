"""Reads with their bases and qualities in compact forms, and reads thinned out evenly or so that alleles stay balanced."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.kernels import align, codec, genotype
from strandlake.kernels import reads as R
from strandlake.operators import reference
from strandlake.operators import variants as V


def compacted(reads: DataFrame) -> DataFrame:
    """Reads with ``packed_seq`` (two bits a base) and ``packed_quals`` (coded differences) in place of seq and base_quals; null for null. Lower case isn't kept."""

    @F.pandas_udf("binary")
    def bases(seqs: pd.Series) -> pd.Series:
        return seqs.map(lambda s: None if s is None else codec.pack_bases(s))

    @F.pandas_udf("binary")
    def qualities(quals: pd.Series) -> pd.Series:
        return quals.map(lambda q: None if q is None else codec.pack_qualities(q))

    return reads.withColumns({"packed_seq": bases("seq"), "packed_quals": qualities("base_quals")}).drop("seq", "base_quals")


def expanded(packed: DataFrame) -> DataFrame:
    """The inverse of ``compacted``."""

    @F.pandas_udf("string")
    def bases(data: pd.Series) -> pd.Series:
        return data.map(lambda s: None if s is None else codec.unpack_bases(bytes(s)))

    @F.pandas_udf("string")
    def qualities(data: pd.Series) -> pd.Series:
        return data.map(lambda q: None if q is None else codec.unpack_qualities(bytes(q)))

    return packed.withColumns({"seq": bases("packed_seq"), "base_quals": qualities("packed_quals")}).drop("packed_seq", "packed_quals")


def levelled(reads: DataFrame, keys: list[str], start: str, target: int, least: int = 1, seed: int = 7) -> DataFrame:
    """Reads of each group (``keys``) cut to about ``target`` by lowering the highest stacks of equal starts evenly; no stack falls below ``least``.

    Sizes of stacks are all that is gathered of a group; which reads of a stack stay is decided by a hash, in salted parts first.
    """
    stacks = reads.groupBy(*keys, start).agg(F.count(F.lit(1)).alias("_n"))
    schema = stacks.withColumnRenamed("_n", "_keep").schema

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(start, na_position="first")
        return pdf.assign(_keep=genotype.levelled(pdf["_n"].astype(int).tolist(), target, least)).drop(columns="_n")

    sizes = stacks.groupBy(*keys).applyInPandas(cut, schema)
    names = {c: f"_s{i}" for i, c in enumerate([*keys, start])}
    sizes = sizes.withColumnsRenamed(names)
    joined = reads.join(sizes, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    rows = joined.withColumns({"_h": F.xxhash64("record_id", F.lit(seed)), "_salt": F.pmod(F.col("record_id"), F.lit(32))})
    for place in ([*names, "_salt"], list(names)):
        rows = rows.withColumn("_at", F.row_number().over(W.partitionBy(*place).orderBy("_h", "record_id"))).where(F.col("_at") <= F.col("_keep"))
    return rows.select(*reads.columns)


def balanced_removal(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, allele, n, removed) of counts (keys, allele, n): how many reads of each allele go so that ``share`` of the site's go and what stays looks like one or two alleles.

    A site has few alleles, so it is one row.
    """

    @F.pandas_udf("array<int>")
    def removal(ns: pd.Series) -> pd.Series:
        return pd.Series([genotype.biased_removal([int(x) for x in row], int(sum(row) * share)) for row in ns])

    packed = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("allele", "n"))).alias("_a"))
    removed = packed.withColumn("_r", removal(F.col("_a.n")))
    return removed.select(*keys, F.inline(F.arrays_zip("_a", F.col("_r").alias("removed")))).select(*keys, F.col("_a.allele").alias("allele"), F.col("_a.n").alias("n"), "removed")


def _with_window(rows: DataFrame, refs: DataFrame, before: int, after: int) -> DataFrame:
    """Records (record_id, contig, contig_position, ref_allele, alt, one alternate each) with ``window``, the reference around them, and ``window_start``."""
    numbered = rows.withColumn("_key", F.concat_ws(":", F.col("record_id").cast("string"), "alt"))
    spans = numbered.withColumns({"_lo": F.greatest(F.lit(1), F.col("contig_position") - before).cast("bigint"), "_hi": (F.col("contig_position") + F.length("ref_allele") - 1 + after).cast("bigint")})
    with_ref = reference.with_reference(spans.dropDuplicates(["_key"]), refs, "_lo", "_hi", key="_key", out="window")
    return with_ref.withColumnRenamed("ref_start", "window_start").drop("_key", "_lo", "_hi")


def left_aligned(rows: DataFrame, refs: DataFrame, longest: int = 200) -> DataFrame:
    """Biallelic indels moved to the left as far as their bases allow, within ``longest`` bases or to the first base that isn't known; other records stay. Repeated rows are one."""

    @F.pandas_udf("struct<moved:int,ref:string,alt:string>")
    def moved(ref: pd.Series, alt: pd.Series, window: pd.Series, skip: pd.Series) -> pd.DataFrame:
        out = []
        for r, a, w, n in zip(ref, alt, window, skip, strict=True):
            before = w[: int(n)].rpartition("N")[2]
            out.append(align.left_aligned(r, a, before) if len(r) != len(a) and not a.startswith(("<", "*")) else (0, r, a))
        return pd.DataFrame(out, columns=["moved", "ref", "alt"])

    got = _with_window(rows, refs, longest, 0).withColumn("_m", moved("ref_allele", "alt", "window", (F.col("contig_position") - F.col("window_start")).cast("int")))
    return got.withColumns({"contig_position": (F.col("contig_position") - F.col("_m.moved")).cast("int"), "ref_allele": F.col("_m.ref"), "alt": F.col("_m.alt")}).drop("_m", "window", "window_start")


def tandem_repeats(rows: DataFrame, refs: DataFrame, after: int = 200) -> DataFrame:
    """(record_id, contig_position, ref_allele, alt, unit, ref_copies, alt_copies) of biallelic indels that add or remove whole units of a repeat."""

    @F.pandas_udf("struct<unit:string,ref_copies:int,alt_copies:int>")
    def found(ref: pd.Series, alt: pd.Series, window: pd.Series) -> pd.DataFrame:
        out = []
        for r, a, w in zip(ref, alt, window, strict=True):
            hit = None if len(r) == len(a) or a.startswith(("<", "*")) else R.tandem_repeat(r, a, w[len(r) :].partition("N")[0])
            out.append(hit or (None, None, None))
        return pd.DataFrame(out, columns=["unit", "ref_copies", "alt_copies"])

    got = _with_window(rows, refs, 0, after).withColumn("_t", found("ref_allele", "alt", "window"))
    return got.where("_t.unit is not null").select("record_id", "contig_position", "ref_allele", "alt", "_t.unit", "_t.ref_copies", "_t.alt_copies")


def one_alternate(variants: DataFrame) -> DataFrame:
    """Records as left_aligned and tandem_repeats take them: a row per plain alternate."""
    rows = variants.select("record_id", "contig", "contig_position", F.upper("ref_allele").alias("ref_allele"), F.explode(V.alts(F.col("alt"))).alias("alt"))
    return rows.where(~V.is_symbolic(F.col("alt"))).withColumn("alt", F.upper("alt"))
