"""Checks and small changes of reads before recalibration, as Column expressions and Arrow-batched functions; and chains of such changes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import readparts
from strandlake.functions.bases import complement
from strandlake.kernels import covariates as K
from strandlake.operators.pileup import placed_operations
from strandlake.tables import FLAG_REVERSE

#: A quality above this can't be one, and what the old encoding adds to all.
HIGHEST_QUALITY, ENCODING_SHIFT = 60, 31


def is_misencoded(quals: Column) -> Column:
    """Whether a quality text holds a value above the highest one."""
    return F.coalesce(quals.rlike(f"[^\\x21-\\x{33 + HIGHEST_QUALITY:02x}]"), F.lit(False))


def reencoded(quals: Column) -> Column:
    """Qualities of the old encoding in the usual one: each less by its shift; characters below it stay."""
    old = "".join(chr(c) for c in range(33 + ENCODING_SHIFT, 127))
    return F.translate(quals, old, "".join(chr(ord(c) - ENCODING_SHIFT) for c in old))


def checked_encoding(reads: DataFrame, fix: bool = False) -> DataFrame:
    """All reads are looked at. Without ``fix`` a misencoded one is an error when it is read; with it all qualities are taken to be of the old encoding."""
    if fix:
        return reads.withColumn("base_quals", F.when(F.col("base_quals").isin("", "*"), F.col("base_quals")).otherwise(reencoded(F.col("base_quals"))))
    fault = F.raise_error(F.concat(F.lit("qualities above the highest one in read "), F.col("read_name"))).cast("string")
    return reads.withColumn("base_quals", F.when(is_misencoded(F.col("base_quals")), fault).otherwise(F.col("base_quals")))


def indel_places(kind: str) -> Column:
    """Offsets of the bases that an insertion (``I``) or a deletion (``D``) follows in the order of sequencing; cigar, contig_position, flag and seq of the row."""
    reverse = F.col("flag").bitwiseAND(FLAG_REVERSE) != 0
    ops = F.filter(placed_operations(F.col("cigar"), F.col("contig_position")), lambda o: o["op"] == kind)
    at = F.transform(ops, lambda o: F.when(reverse, o["off"] + (o["len"] if kind == "I" else F.lit(0))).otherwise(o["off"] - 1))
    return F.filter(at, lambda k: (k >= 0) & (k < F.length("seq")))


def with_repeats(reads: DataFrame) -> DataFrame:
    """Add ``repeat_units`` and ``repeat_lengths`` of each base of the sequence."""

    @F.pandas_udf("struct<units:array<string>,lengths:array<int>>")
    def found(seqs: pd.Series) -> pd.DataFrame:
        rows = []
        for s in seqs:
            pairs = [K.repeat_at(s, i) for i in range(len(s))] if s else []
            rows.append(([u for u, _ in pairs], [n for _, n in pairs]))
        return pd.DataFrame(rows, columns=["units", "lengths"])

    return reads.withColumn("_r", found(F.upper("seq"))).withColumns({"repeat_units": F.col("_r.units"), "repeat_lengths": F.col("_r.lengths")}).drop("_r")


def with_fractional_errors(rows: DataFrame, errors: str = "errors", certainty: str = "certainty") -> DataFrame:
    """Add ``fractions`` to rows with an array of 0 and 1 and a text of the same length."""

    @F.pandas_udf("array<double>")
    def shared(e: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([K.fractional_errors([int(x) for x in a], b) for a, b in zip(e, c, strict=True)])

    return rows.withColumn("fractions", shared(errors, certainty))


def colour_checked(reads: DataFrame, read_groups: DataFrame, without_colours: str = "error") -> DataFrame:
    """Reads of the two-base platform with ``inconsistent``: the offsets, in the order of sequencing, of bases that their colour tag doesn't give; null for all other reads.

    without_colours: what becomes of such a read without the tag: ``error`` when it is read, ``leave`` (as it is) or ``drop``.
    """
    groups = read_groups.groupBy(F.col("read_group").alias("_g")).agg((F.max(readparts.platform(F.col("platform"))) == "SOLID").alias("_two_base"))
    rows = reads.join(groups, F.col("read_group") == F.col("_g"), "left").withColumn("_two_base", F.coalesce("_two_base", F.lit(False))).drop("_g")
    tag = F.get(F.filter(F.coalesce("attributes", F.array().cast("array<string>")), lambda t: t.startswith("CS:Z:")), F.lit(0))
    rows = rows.withColumn("_cs", F.substring(tag, 6, 1 << 20))
    missing = F.col("_two_base") & F.col("_cs").isNull()
    if without_colours == "drop":
        rows = rows.where(~missing)
    elif without_colours == "error":
        rows = rows.withColumn("seq", F.when(missing, F.raise_error(F.concat(F.lit("no colours in read "), F.col("read_name"))).cast("string")).otherwise(F.col("seq")))

    @F.pandas_udf("array<int>")
    def offsets(seqs: pd.Series, colours: pd.Series) -> pd.Series:
        return pd.Series([[i for i, x in enumerate(K.colour_inconsistencies(s, c)) if x] if s is not None and c is not None else None for s, c in zip(seqs, colours, strict=True)])

    reverse = F.col("flag").bitwiseAND(FLAG_REVERSE) != 0
    sequenced = F.when(reverse, complement(F.reverse("seq"))).otherwise(F.col("seq"))
    wanted = F.col("_two_base") & F.col("_cs").isNotNull()
    return rows.withColumn("inconsistent", offsets(F.when(wanted, sequenced), F.when(wanted, F.col("_cs")))).drop("_two_base", "_cs")


def transformed(reads: DataFrame, steps: list[tuple[Callable[[DataFrame], DataFrame], str]]) -> DataFrame:
    """Reads after a chain of changes. Each step has its place: ``first``, ``any`` or ``last``; two firsts or lasts are an error. Steps of a kind keep their order."""
    places = [p for _, p in steps]
    if any(p not in ("first", "any", "last") for p in places) or places.count("first") > 1 or places.count("last") > 1:
        raise ValueError("a chain has one first and one last step at most")
    for wanted in ("first", "any", "last"):
        for step, place in steps:
            if place == wanted:
                reads = step(reads)
    return reads
