"""Bases and sequences as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases in the order of their index, and their complements.
BASES = "ACGT"
_FROM, _TO = "ACGTacgtNn", "TGCAtgcaNn"


def base_index(base: Column) -> Column:
    """0 to 3 for A, C, G, T in any case, else -1."""
    return F.when(base.isin(*BASES, *BASES.lower()), F.instr(F.lit(BASES), F.upper(base)) - 1).otherwise(F.lit(-1))


def is_regular(base: Column) -> Column:
    return F.upper(base).isin(*BASES)


def bases_equal(a: Column, b: Column) -> Column:
    return F.upper(a) == F.upper(b)


def substitution_class(a: Column, b: Column) -> Column:
    """``transition`` between purines or between pyrimidines, else ``transversion``; null for equal or irregular bases."""
    a, b = F.upper(a), F.upper(b)
    pair = F.concat(a, b)
    return F.when(~is_regular(a) | ~is_regular(b) | (a == b), F.lit(None)).when(pair.isin("AG", "GA", "CT", "TC"), "transition").otherwise("transversion")


def complement(seq: Column) -> Column:
    return F.translate(seq, _FROM, _TO)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def iupac_to_n(seq: Column) -> Column:
    """Ambiguity codes as N; bases, N and gaps stay."""
    return F.regexp_replace(seq, "[^ACGTNacgtn.*-]", "N")


def reference_bases(seq: Column) -> Column:
    """What is no base becomes N, upper case."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def context(seq: Column, offset: Column, k: int) -> Column:
    """The k bases that end at a 0-based offset; null where they would begin before the sequence or hold an N."""
    text = F.substring(seq, offset - (k - 1) + 1, F.lit(k))
    return F.when((offset >= k - 1) & (F.length(text) == k) & text.rlike("^[ACGT]+$"), text)


def flanked(seq: Column, offset: Column, width: int = 3) -> Column:
    """``width`` bases, ``x``, ``width`` bases around a 0-based offset; shorter at the ends."""
    start = F.greatest(F.lit(0), offset - width)
    return F.concat(F.substring(seq, start + 1, offset - start), F.lit("x"), F.substring(seq, offset + 2, F.lit(width)))


def kmers(seq: Column, k: int) -> Column:
    """array of all substrings of length k."""
    last = F.length(seq) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(seq, i + 1, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def complexity(seq: Column, k: int = 3) -> Column:
    """Distinct k-mers among all k-mers."""
    found = kmers(seq, k)
    return F.when(F.size(found) > 0, F.size(F.array_distinct(found)) / F.size(found))


def repeat_count(seq: Column, unit: str, leading: bool = True) -> Column:
    """How many times the unit is repeated at the start (or end)."""
    run = F.regexp_extract(seq, f"^(?:{unit})+" if leading else f"(?:{unit})+$", 0)
    return F.floor(F.length(run) / len(unit))


def smallest_period(seq: Column) -> Column:
    """Length of the shortest unit whose repeats make the sequence."""
    n = F.length(seq)
    periods = F.filter(F.sequence(F.lit(1), n), lambda p: (F.pmod(n, p) == 0) & (F.repeat(F.substring(seq, F.lit(1), p), (n / p).cast("int")) == seq))
    return F.when(n > 0, F.array_min(periods))
