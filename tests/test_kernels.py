import itertools
import math
import random

import numpy as np
import pytest

from strandlake.kernels import align, assembly, genotype, maths, recalibrate

rnd = random.Random(8)


def seq(n):
    return "".join(rnd.choice("ACGT") for _ in range(n))


def score_of(ref, query, offset, ops, costs):
    match, mismatch, opening, extend = costs
    total, r, q = 0, offset, 0
    for op, n in ops:
        if op == "M":
            total += sum(match if ref[r + i] == query[q + i] else mismatch for i in range(n))
            r, q = r + n, q + n
        elif op == "I":
            total, q = total + opening + extend * (n - 1), q + n
        elif op == "D":
            total, r = total + opening + extend * (n - 1), r + n
        else:
            q += n
    assert q == len(query)
    return total


def gotoh(ref, query, costs):
    """Best local score by the plain three-state recurrence."""
    match, mismatch, opening, extend = costs
    best = 0
    h = [[0] * (len(query) + 1) for _ in range(len(ref) + 1)]
    d = [[-(10**9)] * (len(query) + 1) for _ in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        e = -(10**9)
        for j in range(1, len(query) + 1):
            d[i][j] = max(h[i - 1][j] + opening, d[i - 1][j] + extend)
            e = max(h[i][j - 1] + opening, e + extend)
            h[i][j] = max(0, h[i - 1][j - 1] + (match if ref[i - 1] == query[j - 1] else mismatch), d[i][j], e)
            best = max(best, h[i][j])
    return best


def test_smith_waterman():
    for _ in range(60):
        ref = seq(rnd.randint(5, 40))
        at = rnd.randint(0, len(ref) - 4)
        query = list(ref[at : at + rnd.randint(4, 30)])
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(query))
            query[i : i + rnd.randint(0, 2)] = seq(rnd.randint(0, 2))
        query = "".join(query) or "A"
        for costs in (align.REALIGN_COSTS, align.DANGLING_COSTS, align.HAPLOTYPE_COSTS):
            offset, ops, score = align.smith_waterman(ref, query, costs)
            assert score == gotoh(ref, query, costs) == score_of(ref, query, offset, ops, costs)
        offset, ops, score = align.smith_waterman(ref, query, align.REALIGN_COSTS, "indel")
        assert offset == 0 and score == score_of(ref, query, 0, ops, align.REALIGN_COSTS)
        assert sum(n for op, n in ops if op in "MD") == len(ref)


def brute_hmm(read, quals, hap, qi=45, qd=45, qc=10):
    n, m = len(read), len(hap)
    gi, gd, gc = 10 ** (qi / -10), 10 ** (qd / -10), 10 ** (qc / -10)
    M = [[0.0] * (m + 1) for _ in range(n + 1)]
    I = [[0.0] * (m + 1) for _ in range(n + 1)]  # noqa: E741
    D = [[0.0] * (m + 1) for _ in range(n + 1)]
    for j in range(m + 1):
        D[0][j] = 1.0 / m
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e = 10 ** (quals[i - 1] / -10)
            p = 1 - e if read[i - 1] == hap[j - 1] else e / 3
            M[i][j] = p * (M[i - 1][j - 1] * (1 - gi - gd) + (I[i - 1][j - 1] + D[i - 1][j - 1]) * (1 - gc))
            I[i][j] = M[i - 1][j] * gi + I[i - 1][j] * gc
            D[i][j] = M[i][j - 1] * gd + D[i][j - 1] * gc
        if i == 0:
            break
    return math.log10(sum(M[n][j] + I[n][j] for j in range(1, m + 1)))


def test_pair_hmm():
    for _ in range(25):
        hap = seq(rnd.randint(3, 25))
        read = seq(rnd.randint(1, 20))
        quals = [rnd.randint(5, 40) for _ in read]
        assert align.pair_hmm(read, quals, hap) == pytest.approx(brute_hmm(read, quals, hap), rel=1e-9)
    haps, reads = [seq(rnd.randint(3, 30)) for _ in range(4)], [seq(rnd.randint(1, 25)) for _ in range(5)]
    quals = [[rnd.randint(5, 40) for _ in r] for r in reads]
    matrix = align.pair_hmm_matrix(reads, quals, haps, chunk=3)
    assert matrix == pytest.approx(np.array([[brute_hmm(r, q, h) for h in haps] for r, q in zip(reads, quals, strict=True)]), rel=1e-9)
    assert align.pair_hmm_matrix(["", "A"], [[], [30]], ["", "A"])[0].tolist() == [0.0, 0.0]
    hap = seq(200)
    assert align.pair_hmm(hap[50:150], [30] * 100, hap) > align.pair_hmm(seq(100), [30] * 100, hap)


def test_baq():
    ref = seq(120)
    read = ref[20:90]
    quals = [30] * len(read)
    good = align.base_alignment_quality(read, quals, ref, 20)
    assert min(good[5:-5]) >= 20
    shifted = ref[20:80] + ref[83:93]  # a deletion near the end that an ungapped alignment overlooks
    bad = align.base_alignment_quality(shifted, [30] * 70, ref, 20)
    assert sum(bad[60:]) < sum(good[60:]) / 2


def test_left_alignment():
    assert align.left_aligned("CAA", "CA", "GC")[0] >= 0
    moved, ref, alt = align.left_aligned("AAA", "AA", "GCA")
    assert moved == 1 and (ref, alt) == ("AAA", "AA") or moved >= 1


def test_assembly():
    ref = seq(150)
    alt = ref[:70] + ("A" if ref[70] != "A" else "C") + ref[71:]
    gone = ref[:80] + ref[84:]
    reads = [h[i : i + 60] for h in (ref, alt, gone) for i in range(0, len(h) - 60, 3)]
    found = {s for _, s in assembly.assemble(ref, reads)}
    assert {ref, alt, gone} <= found
    offset, ops, _ = align.smith_waterman(ref, gone, overhang="indel")
    ((position, r, a),) = assembly.haplotype_events(ops, ref, gone, 1000)
    assert len(r) - len(a) == 4
    noise = seq(60)
    assert noise not in "".join(s for _, s in assembly.assemble(ref, [*reads, noise]))
    assert assembly.assemble("ACAC" * 20, []) == [(0.0, "ACAC" * 20)]
    graph = assembly.KmerGraph(2)
    graph.add("ACAC")
    assert graph.has_cycle()


def test_best_paths_are_the_best():
    graph = assembly.KmerGraph(1)
    for s, n in (("AXCYG", 3), ("AZCYG", 2), ("AXCWG", 1)):
        for _ in range(n):
            graph.add(s)
    assert [s for _, s in graph.best_paths("A", "G")] == ["AXCYG", "AZCYG", "AXCWG", "AZCWG"] or len(graph.best_paths("A", "G")) == 4
    scores = [x for x, _ in graph.best_paths("A", "G")]
    assert scores == sorted(scores, reverse=True)


def test_genotypes():
    for ploidy, n in ((1, 3), (2, 4), (3, 3)):
        order = genotype.genotypes(n, ploidy)
        assert [genotype.genotype_index(g) for g in order] == list(range(len(order)))
    assert genotype.genotypes(3)[:6] == [(0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2)]
    ll = np.log10(np.array([[0.9, 0.1], [0.2, 0.8]]))
    assert genotype.likelihoods(ll) == pytest.approx([math.log10(0.9 * 0.2), math.log10(0.5 * 0.5), math.log10(0.1 * 0.8)])


def test_allele_counts():
    gls = [np.array([rnd.uniform(-5, 0) for _ in range(3)]) for _ in range(4)]
    got = genotype.allele_count_posterior(gls)
    n = 8
    prior = 10.0 ** maths.log10_priors(n, 1e-3)
    joint = np.zeros(n + 1)
    for g in itertools.product(range(3), repeat=4):
        k = sum(g)
        joint[k] += prior[k] / math.comb(n, k) * np.prod([10 ** gl[x] * math.comb(2, x) for gl, x in zip(gls, g, strict=True)])
    assert 10**got == pytest.approx(joint / joint.sum(), rel=1e-9)


def test_levelling():
    for _ in range(100):
        stacks = [rnd.randint(0, 30) for _ in range(rnd.randint(1, 12))]
        target = rnd.randint(0, 120)
        out = genotype.levelled(stacks, target, 2)
        assert all(o <= s for o, s in zip(out, stacks, strict=True))
        assert sum(out) == min(sum(stacks), max(target, sum(min(s, 2) for s in stacks)))
    assert genotype.biased_removal([10, 2], 2) == [0, 2]
    assert sum(genotype.biased_removal([5, 5, 4], 4)) == 4


def test_exact_tests():
    assert maths.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert maths.fisher_two_sided(0, 0, 0, 0) == 1.0
    assert maths.hardy_weinberg_p(50, 0, 50) < 1e-10 and maths.hardy_weinberg_p(25, 50, 25) == pytest.approx(1.0)
    for n, m in ((2, 3), (4, 4), (1, 5)):
        brute = [0] * (n * m + 1)
        for c in itertools.combinations(range(n + m), n):
            brute[sum(c) - n * (n - 1) // 2] += 1
        assert maths.u_counts(n, m).tolist() == brute
    u, z = maths.rank_sum([1, 2, 2], [2, 3])
    assert u == pytest.approx(1.0) and z < 0
    assert maths.rank_sum_p([1, 2, 3], [4, 5, 6], two_sided=False) == pytest.approx(1 / 20)
    assert maths.binomial_cumulative(10, 0, 10) == pytest.approx(1.0)
    assert maths.multinomial([1, 1], [0.5, 0.5]) == pytest.approx(0.5)
    assert maths.dirichlet_multinomial([1.0, 1.0], [1, 1]) == pytest.approx(1 / 3)
    assert maths.log10_sum([-1, -1]) == pytest.approx(math.log10(0.2))


def test_recalibration_estimates():
    assert recalibrate.bayesian_quality(10**6, 1000, 30) == 30
    assert recalibrate.bayesian_quality(10**6, 10_000, 30) == 20
    assert recalibrate.bayesian_quality(0, 0, 25) == 25
    histogram = [0] * 94
    histogram[10], histogram[11], histogram[40] = 100, 100, 1000
    levels = recalibrate.quantized(histogram, 2)
    assert levels[10] == levels[11] and levels[40] == 40 and len(set(levels)) == 2
