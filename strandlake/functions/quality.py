"""Phred scores and log10 probabilities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the largest quality that has a text form.
MAX_QUALITY = 93


def qual_to_error(q: Column) -> Column:
    return F.pow(F.lit(10.0), q / F.lit(-10.0))


def qual_to_probability(q: Column) -> Column:
    return 1 - qual_to_error(q)


def qual_to_error_log10(q: Column) -> Column:
    return q / F.lit(-10.0)


def bounded(q: Column, most: int = MAX_QUALITY) -> Column:
    return F.greatest(F.lit(1), F.least(q, F.lit(most)))


def error_to_qual(e: Column, most: int = MAX_QUALITY) -> Column:
    """Rounded and bounded to 1..most; an error of 0 gets the most."""
    return F.when(e <= 0, F.lit(most)).otherwise(bounded(F.round(-10 * F.log10(e)).cast("int"), most))


def scaled_correct_rate(p: Column) -> Column:
    return F.abs(-10 * F.log10(F.greatest(1 - p, F.lit(1e-300))))


def log10_sum(values: Column) -> Column:
    """log10 of the sum of 10**x over an array."""
    top = F.array_max(values)
    return top + F.log10(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - top)))


def normalized_log10(values: Column) -> Column:
    """10**x scaled to sum to 1."""
    total = log10_sum(values)
    return F.transform(values, lambda x: F.pow(F.lit(10.0), x - total))


def log10_one_minus(x: Column) -> Column:
    """log10(1 - 10**x) for x < 0."""
    return F.log1p(-F.pow(F.lit(10.0), x)) / F.log(F.lit(10.0))


def normal_density(x: Column, mean: float, sd: float) -> Column:
    return F.exp(-F.pow((x - mean) / sd, 2) / 2) / (sd * F.sqrt(2 * F.pi()))


def rms(x: Column) -> Column:
    """Aggregate: root mean square."""
    return F.sqrt(F.avg(x.cast("double") * x))


def upper_median(values: Column) -> Column:
    """The element at size/2 of the sorted array: the upper one of two middle elements."""
    return F.element_at(F.sort_array(values), F.floor(F.size(values) / 2).cast("int") + 1)


def mad(values: Column) -> Column:
    """Median absolute deviation, with medians that average two middle elements."""

    def median(v: Column) -> Column:
        s, n = F.sort_array(v), F.size(v)
        return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2.0

    middle = median(values)
    return median(F.transform(values, lambda x: F.abs(x - middle)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def quality_at(quals: Column, offset: Column) -> Column:
    """Phred score at a 0-based offset of a quality text."""
    return F.ascii(F.substring(quals, offset + 1, F.lit(1))) - 33


def added(a: Column, b: Column, sign: float = 1.0) -> Column:
    """Sum (or with -1 difference) of two arrays, item by item."""
    return F.zip_with(a, b, lambda x, y: x + y * sign)


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("int")


#: Step of a table of log10(1 + 10**-d), and the difference from which it is 0.
TABLE_STEP, TABLE_END = 1e-4, 8.0


def log10_sum_by_table(a: Column, b: Column) -> Column:
    """log10(10**a + 10**b) with the smaller one's share taken at steps of ``TABLE_STEP`` of the difference, as a table has it."""
    d = F.abs(a - b)
    share = F.log10(1 + F.pow(F.lit(10.0), -F.round(d / TABLE_STEP) * TABLE_STEP))
    return F.greatest(a, b) + F.when(d >= TABLE_END, 0.0).otherwise(share)


def log10_spaced(first: int, last: int, n: int) -> Column:
    """Array of ``n`` whole numbers from first to last, evenly spaced in their logarithms; equal ones once."""
    import math

    low, high = math.log10(first), math.log10(last)
    values = dict.fromkeys(round(10 ** (low + (high - low) * i / max(1, n - 1))) for i in range(n))
    return F.array(*(F.lit(v) for v in values))
