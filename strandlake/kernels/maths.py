"""Numerical functions that SQL lacks: log gamma, exact tests, binomials. Plain numpy and Python on values or small arrays."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np

LOG10_E = math.log10(math.e)


def log10_gamma(x: float) -> float:
    return math.lgamma(x) * LOG10_E


def log10_factorial(n: float) -> float:
    return log10_gamma(n + 1)


def log10_binomial_coefficient(n: float, k: float) -> float:
    return log10_factorial(n) - log10_factorial(k) - log10_factorial(n - k)


def log10_binomial(n: float, k: float, log10_p: float) -> float:
    """log10 of the probability of k successes in n at a success probability of 10**log10_p."""
    rest = math.log10(-math.expm1(log10_p * math.log(10))) if log10_p < 0 else float("-inf")
    return log10_binomial_coefficient(n, k) + (log10_p * k if k else 0.0) + (rest * (n - k) if n > k else 0.0)


def binomial_cumulative(n: int, k_from: int, k_to: int, p: float = 0.5) -> float:
    lp = math.log10(p)
    return min(1.0, sum(10 ** log10_binomial(n, k, lp) for k in range(k_from, k_to + 1)))


def log10_multinomial_coefficient(n: int, ks: list[int]) -> float:
    return log10_factorial(n) - sum(log10_factorial(k) for k in ks)


def multinomial(ks: list[int], ps: list[float]) -> float:
    if any(p == 0 and k for p, k in zip(ps, ks, strict=True)):
        return 0.0
    return 10 ** (log10_multinomial_coefficient(sum(ks), ks) + sum(k * math.log10(p) for p, k in zip(ps, ks, strict=True) if k))


def dirichlet_multinomial(alphas: list[float], counts: list[int]) -> float:
    a, n = sum(alphas), sum(counts)
    value = log10_multinomial_coefficient(n, counts) + log10_gamma(a) - log10_gamma(a + n)
    return 10 ** (value + sum(log10_gamma(x + c) - log10_gamma(x) for x, c in zip(alphas, counts, strict=True)))


def log10_sum(values) -> float:
    values = np.asarray(values, float)
    top = values.max() if values.size else -np.inf
    return float(top) if not np.isfinite(top) else float(top + np.log10(np.sum(10.0 ** (values - top))))


def fisher_two_sided(a: int, b: int, c: int, d: int, most: int = 200) -> float:
    """P value of a 2x2 table: the sum over tables of the same margins that are no likelier. Tables of more than twice ``most`` are scaled to ``most``."""
    total = a + b + c + d
    if total > 2 * most:
        a, b, c, d = (int(x * most / total) for x in (a, b, c, d))
        total = a + b + c + d
    row, column = a + b, a + c
    lo, hi = max(0, column - (total - row)), min(row, column)
    base = log10_binomial_coefficient(total, column) if total else 0.0
    logs = [log10_binomial_coefficient(row, x) + log10_binomial_coefficient(total - row, column - x) - base for x in range(lo, hi + 1)]
    own = logs[a - lo]
    return min(1.0, sum(10**x for x in logs if x <= own + 1e-7))


def strand_odds_ratio(rf: float, rr: float, af: float, ar: float) -> float:
    """Natural log of the symmetric odds ratio, scaled by the balance of either allele; one is added to every cell."""
    rf, rr, af, ar = rf + 1, rr + 1, af + 1, ar + 1
    ratio = (rf * ar) / (rr * af)
    return math.log(ratio + 1 / ratio) + math.log(min(rf, rr) / max(rf, rr)) - math.log(min(af, ar) / max(af, ar))


def rank_sum(xs, ys) -> tuple[float, float]:
    """(U of xs, z by the normal approximation) with mid-ranks and the correction of the variance for ties; z is nan where undefined."""
    xs, ys = np.asarray(xs, float), np.asarray(ys, float)
    n, m = len(xs), len(ys)
    if not n or not m:
        return float("nan"), float("nan")
    both = np.concatenate([xs, ys])
    _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
    last = np.cumsum(counts)
    mid = (last - counts + 1 + last) / 2.0
    u = float(mid[inverse[:n]].sum() - n * (n + 1) / 2)
    size = n + m
    ties = float((counts.astype(float) ** 3 - counts).sum())
    variance = n * m / 12.0 * (size + 1 - ties / (size * (size - 1))) if size > 1 else 0.0
    return u, (u - n * m / 2.0) / math.sqrt(variance) if variance > 0 else float("nan")


def u_counts(n: int, m: int) -> np.ndarray:
    """How many orders of n and m distinct values give each U (0 to n*m), by the generating polynomial."""
    ways = np.zeros(n * m + 1)
    ways[0] = 1
    for i in range(1, n + 1):  # times (1 - x^(m+i)) / (1 - x^i)
        step = np.zeros_like(ways)
        step[:] = ways
        if m + i <= n * m:
            step[m + i :] -= ways[: n * m + 1 - m - i]
        for j in range(i, n * m + 1):
            step[j] += step[j - i]
        ways = step
    return ways


def rank_sum_p(xs, ys, two_sided: bool = True, exact_up_to: int = 10) -> float:
    """P value of the rank sum: exact for few distinct values, else by the normal approximation."""
    u, z = rank_sum(xs, ys)
    n, m = len(xs), len(ys)
    if math.isnan(u):
        return float("nan")
    if max(n, m) <= exact_up_to and len({*xs, *ys}) == n + m:
        ways = u_counts(n, m)
        lower = float(ways[: int(u) + 1].sum() / ways.sum())
        upper = float(ways[int(u) :].sum() / ways.sum())
    elif math.isnan(z):
        return float("nan")
    else:
        lower = 0.5 * math.erfc(-z / math.sqrt(2))
        upper = 1 - lower
    return min(1.0, 2 * min(lower, upper)) if two_sided else lower


def hardy_weinberg_p(hom_ref: int, het: int, hom_alt: int) -> float:
    """Exact two-sided p value of the heterozygote count given the allele counts."""
    rare, n = 2 * min(hom_ref, hom_alt) + het, hom_ref + het + hom_alt
    if n == 0:
        return 1.0
    hets = np.arange(rare % 2, rare + 1, 2)
    homs = (rare - hets) // 2
    logs = np.array([h * math.log10(2) - log10_factorial(h) - log10_factorial(r) - log10_factorial(n - h - r) for h, r in zip(hets.tolist(), homs.tolist(), strict=True)])
    probabilities = 10 ** (logs - log10_sum(logs))
    own = probabilities[np.searchsorted(hets, het)]
    return float(min(1.0, probabilities[probabilities <= own * (1 + 1e-9)].sum()))


def median_and_mad(values) -> tuple[float, float]:
    values = np.asarray(values, float)
    middle = float(np.median(values))
    return middle, float(np.median(np.abs(values - middle)))


def log10_priors(n_chromosomes: int, heterozygosity: float) -> np.ndarray:
    """log10 priors of 0..n alternate alleles: theta/i for i > 0, the remainder for 0."""
    rest = heterozygosity / np.arange(1, n_chromosomes + 1)
    return np.log10(np.concatenate([[max(1e-300, 1 - rest.sum())], rest]))


def product(values) -> int:
    return reduce(lambda a, b: a * b, values, 1)
