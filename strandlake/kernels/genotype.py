"""Genotype likelihoods of any ploidy, exact allele frequency posteriors, and choices of reads to remove."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np

from strandlake.kernels.maths import log10_priors, log10_sum


def genotypes(n_alleles: int, ploidy: int = 2) -> list[tuple[int, ...]]:
    """All genotypes in the order of PL: by the largest allele, then the next."""
    return sorted(combinations_with_replacement(range(n_alleles), ploidy), key=lambda g: g[::-1])


def genotype_index(alleles: tuple[int, ...]) -> int:
    """Place of a genotype in that order, by counting those before it."""
    return sum(math.comb(a + i, i + 1) for i, a in enumerate(sorted(alleles)))


def likelihoods(read_by_allele: np.ndarray, ploidy: int = 2) -> np.ndarray:
    """log10 likelihood of each genotype from log10 likelihoods (reads x alleles): a read comes from any of the chromosomes alike."""
    reads, n = read_by_allele.shape
    out = []
    for g in genotypes(n, ploidy):
        counts = np.bincount(g, minlength=n)
        used = np.flatnonzero(counts)
        terms = read_by_allele[:, used] + np.log10(counts[used] / ploidy)
        top = terms.max(axis=1, keepdims=True) if reads else np.zeros((0, 1))
        out.append(float((top[:, 0] + np.log10((10.0 ** (terms - top)).sum(axis=1))).sum()) if reads else 0.0)
    return np.array(out)


def phred(gls: np.ndarray) -> list[int]:
    return [int(round(min(x, 2**31 - 1))) for x in -10 * (gls - gls.max())]


def allele_count_posterior(gls: list[np.ndarray], heterozygosity: float = 1e-3) -> np.ndarray:
    """log10 posterior of 0..2n alternate alleles among n diploid samples, from their log10 likelihoods of 0, 1 and 2.

    The sum over genotypes of all samples is a product of polynomials in the count, one factor per sample, with the number of chromosomes that
    carry the alternates divided out at the end. Each step is scaled against underflow.
    """
    ways, scale = np.array([1.0]), 0.0
    for gl in gls:
        top = gl.max()
        factor = 10.0 ** (gl - top) * np.array([1.0, 2.0, 1.0])
        ways = np.convolve(ways, factor)
        peak = ways.max()
        ways, scale = ways / peak, scale + top + math.log10(peak)
    n = 2 * len(gls)
    choose = np.array([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(n + 1)]) / math.log(10)
    with np.errstate(divide="ignore"):
        joint = np.log10(ways) + scale - choose + log10_priors(n, heterozygosity)
    return joint - log10_sum(joint)


def site_quality(gls: list[np.ndarray], heterozygosity: float = 1e-3) -> tuple[float, int]:
    """(phred of the chance that there is no alternate, likeliest number of alternates)."""
    posterior = allele_count_posterior(gls, heterozygosity)
    return float(-10 * posterior[0]) + 0.0, int(posterior.argmax())


def site_qualities(site: np.ndarray, gls: np.ndarray, heterozygosity: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """``site_quality`` of many sites 0, 1, ... at once: gls has a row per sample of each site, sites one after the other. Sites of equally many samples are one array."""
    first = np.flatnonzero(np.r_[True, site[1:] != site[:-1]]) if len(site) else np.zeros(0, np.int64)
    many = np.diff(np.r_[first, len(site)])
    qual, count = np.zeros(len(first)), np.zeros(len(first), np.int64)
    for n in np.unique(many).tolist():
        own = np.flatnonzero(many == n)
        ways, scale = np.ones((len(own), 1)), np.zeros(len(own))
        for k in range(n):
            gl = gls[first[own] + k]
            top = gl.max(axis=1)
            factor = 10.0 ** (gl - top[:, None]) * np.array([1.0, 2.0, 1.0])
            wider = np.zeros((len(own), ways.shape[1] + 2))
            for j in range(3):
                wider[:, j : j + ways.shape[1]] += ways * factor[:, j : j + 1]
            peak = wider.max(axis=1)
            ways, scale = wider / peak[:, None], scale + top + np.log10(peak)
        choose = np.array([math.lgamma(2 * n + 1) - math.lgamma(k + 1) - math.lgamma(2 * n - k + 1) for k in range(2 * n + 1)]) / math.log(10)
        with np.errstate(divide="ignore"):
            joint = np.log10(ways) + scale[:, None] - choose + log10_priors(2 * n, heterozygosity)
        top = joint.max(axis=1)
        sums = top + np.log10((10.0 ** (joint - top[:, None])).sum(axis=1))
        qual[own], count[own] = -10 * (joint[:, 0] - sums) + 0.0, joint.argmax(axis=1)
    return qual, count


def levelled(stacks: list[int], target: int, least: int = 1) -> list[int]:
    """Sizes of stacks whose sum is cut to the target by lowering the highest evenly; none below ``least`` (or its own size)."""
    if sum(stacks) <= target:
        return list(stacks)
    floor = [min(s, least) for s in stacks]
    lo, hi = 0, max(stacks)
    while lo < hi:  # the largest level whose sum fits
        level = (lo + hi + 1) // 2
        if sum(max(f, min(s, level)) for s, f in zip(stacks, floor, strict=True)) <= target:
            lo = level
        else:
            hi = level - 1
    out = [max(f, min(s, lo)) for s, f in zip(stacks, floor, strict=True)]
    spare = target - sum(out)
    for i, s in enumerate(stacks):
        if spare > 0 and s > out[i]:
            out[i] += 1
            spare -= 1
    return out


def biased_removal(counts: list[int], remove: int) -> list[int]:
    """How many of each allele's reads to take away, ``remove`` in all, so that two alleles in equal or one allele in all reads is met best."""
    n = len(counts)
    if sum(counts) <= remove:
        return list(counts)

    def score(c: list[int]) -> float:
        total = sum(c)
        first, second = sorted(c, reverse=True)[:2] if n > 1 else (c[0], 0)
        return min(total - first, abs(first - second) + (total - first - second))

    best = None
    for i in range(n):
        for j in range(i, n):
            for share in {0, remove, remove // 2}:
                c = list(counts)
                a = min(c[i], share)
                c[i] -= a
                b = min(c[j], remove - a)
                c[j] -= b
                if sum(counts) - sum(c) == remove and (best is None or score(c) < score(best)):
                    best = c
    if best is None:  # more than two alleles must give
        best, left = list(counts), remove
        for i in sorted(range(n), key=lambda x: counts[x]):
            take = min(best[i], left)
            best[i] -= take
            left -= take
    return [a - b for a, b in zip(counts, best, strict=True)]


def pooled_posterior(gls: list[np.ndarray], heterozygosity: float = 1e-3, priors: np.ndarray | None = None) -> np.ndarray:
    """log10 posterior of the number of alternates over samples or pools of any ploidy, from their log10 likelihoods of 0..ploidy alternates.

    The samples are independent draws of one population; ``priors`` (log10, one for each count) stand in for those of the heterozygosity.
    """
    ways, scale, n = np.array([1.0]), 0.0, 0
    for gl in gls:
        m = len(gl) - 1
        top = gl.max()
        ways = np.convolve(ways, 10.0 ** (gl - top) * np.array([math.comb(m, k) for k in range(m + 1)], float))
        peak = ways.max()
        ways, scale, n = ways / peak, scale + top + math.log10(peak), n + m
    choose = np.array([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(n + 1)]) / math.log(10)
    with np.errstate(divide="ignore"):
        joint = np.log10(ways) + scale - choose + (log10_priors(n, heterozygosity) if priors is None else priors)
    return joint - log10_sum(joint)


def linear_posterior(gls: list[np.ndarray], heterozygosity: float = 1e-3) -> np.ndarray:
    """The same for diploid samples by the recurrence over samples: what j chromosomes of k samples can be, from k - 1 samples."""
    column = np.array([1.0])
    scale = 0.0
    for k, gl in enumerate(gls, 1):
        top = gl.max()
        a, b, c = 10.0 ** (gl - top)
        j = np.arange(2 * k + 1)
        held = np.zeros(2 * k + 3)
        held[2 : 2 + len(column)] = column
        new = (2 * k - j) * (2 * k - j - 1) * a * held[2:][: 2 * k + 1] + 2 * j * (2 * k - j) * b * held[1:][: 2 * k + 1] + j * (j - 1) * c * held[: 2 * k + 1]
        new /= max(1, 2 * k * (2 * k - 1))
        peak = new.max()
        column, scale = new / peak, scale + top + math.log10(peak)
    with np.errstate(divide="ignore"):
        joint = np.log10(column) + scale + log10_priors(2 * len(gls), heterozygosity)
    return joint - log10_sum(joint)


#: Fixed value: alternates of a site that are looked at one by one.
MAX_ALTERNATES = 6


def independent_alleles(gls: list[list[np.ndarray]], heterozygosity: float = 1e-3) -> tuple[float, list[int]]:
    """(phred of the chance that there is no alternate at all, likeliest count of each) of several alternates, each against the rest.

    gls: for each alternate, the samples' likelihoods of 0, 1 and 2 copies of it. Alternates are taken to be independent, so their chances to be absent multiply.
    """
    if len(gls) > MAX_ALTERNATES:
        raise ValueError(f"more than {MAX_ALTERNATES} alternates; keep the likeliest with allele_subset")
    posteriors = [pooled_posterior(g, heterozygosity) for g in gls]
    return float(-10 * sum(p[0] for p in posteriors)) + 0.0, [int(p.argmax()) for p in posteriors]


def calculator(ploidy: int, n_alternates: int):
    """The frequency calculator for a ploidy and number of alternates: a function of likelihoods, by sample or for several alternates by alternate and sample."""
    if ploidy == 2 and n_alternates > 1:
        return independent_alleles
    return allele_count_posterior if ploidy == 2 else pooled_posterior


def pool_likelihoods(bases: list[str], quals: list[int], ref: str, alt: str, ploidy: int, error: np.ndarray | None = None) -> np.ndarray:
    """log10 likelihood of 0..ploidy alternates in a pool. error: chances of qualities 0.. of the site (see ``site_errors``), which replace the bases' own where given."""
    share = np.arange(ploidy + 1) / ploidy
    out = np.zeros(ploidy + 1)
    if error is None:
        for b, q in zip(bases, quals, strict=True):
            e = 10 ** (-q / 10)
            hit, miss = 1 - e, e / 3
            out += np.log10((1 - share) * (hit if b == ref else miss) + share * (hit if b == alt else miss))
        return out
    per = np.full((len(error), ploidy + 1), -np.inf)
    for q, chance in enumerate(error):
        if chance > 0:
            e = min(0.75, 10 ** (-q / 10))
            counts = {x: sum(b == x for b in bases) for x in {ref, alt}}
            other = len(bases) - sum(counts.values())
            at = lambda own: (1 - share) * (1 - e if own == ref else e / 3) + share * (1 - e if own == alt else e / 3)
            per[q] = math.log10(chance) + counts[ref] * np.log10(at(ref)) + (counts[alt] * np.log10(at(alt)) if alt != ref else 0) + other * math.log10(e / 3)
    return np.array([log10_sum(per[:, k][np.isfinite(per[:, k])]) for k in range(ploidy + 1)])


def site_errors(n_errors: int, depth: int, highest: int = 40) -> np.ndarray:
    """Chance of each site quality 0..highest after a sample that has no alternate shows so many errors: binomial, all qualities alike before."""
    e = np.clip(10 ** (-np.arange(highest + 1) / 10), 1e-9, 1 - 1e-9)
    log = n_errors * np.log10(e) + (depth - n_errors) * np.log10(1 - e)
    chance = 10 ** (log - log.max())
    return chance / chance.sum()


def phase_sets(events: list[set], hets: list) -> dict:
    """event -> (set number, ``0|1`` or ``1|0``) of heterozygous events that haplotypes hold together or apart; events is the set of each haplotype.

    Two events are in phase where the same haplotypes have both, in opposite phase where each haplotype with an alternate has just one of them and no other
    haplotype has either. An event goes with the first earlier one that it can be phased with.
    """
    carriers = {e: frozenset(i for i, own in enumerate(events) if e in own) for e in hets}
    out: dict = {}
    numbers = 0
    for i, b in enumerate(hets):
        for a in hets[:i]:
            if not carriers[a] or not carriers[b]:
                continue
            together = carriers[a] == carriers[b]
            apart = not carriers[a] & carriers[b] and all(j in carriers[a] | carriers[b] or not own for j, own in enumerate(events))
            if together or apart:
                if a not in out:
                    out[a] = (numbers, "0|1")
                    numbers += 1
                set_of, side = out[a]
                out[b] = (set_of, side if together else "1|0" if side == "0|1" else "0|1")
                break
    return out
