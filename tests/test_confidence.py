import itertools
import math
import random

import numpy as np

from strandlake.kernels import genotype as G
from strandlake.operators import confidence as Q


def test_informative_offsets_against_plain_comparison():
    rnd = random.Random(4)

    def cost(read, quals, ref, i, j):
        return sum(quals[i + k] for k in range(min(len(read) - i, len(ref) - j)) if read[i + k] != ref[j + k])

    for _ in range(60):
        ref = "".join(rnd.choice("AC") for _ in range(rnd.randint(12, 40)))
        n = rnd.randint(4, 30)
        start = rnd.randint(0, 5)
        read = "".join(b if rnd.random() < 0.9 else rnd.choice("ACGT") for b in ref[start : start + n].ljust(n, "G"))
        quals = [rnd.randint(5, 40) for _ in read]
        got = Q.informative_offsets(np.frombuffer(read.encode(), np.uint8), np.array(quals), np.frombuffer(ref.encode(), np.uint8), start, 4)
        for i in range(n):
            j = i + start
            expected = n - i >= 4 and len(ref) - j >= 4 and all(cost(read, quals, ref, i, j + s) > cost(read, quals, ref, i, j) and cost(read, quals, ref, i + s, j) > cost(read, quals, ref, i, j) for s in range(1, 5))
            assert got[i] == expected, (read, ref, start, i)


def test_calculators_agree_with_enumeration():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 3):
        gls = [np.log10(rnd.dirichlet([1, 1, 1])) for _ in range(n)]
        exact = G.allele_count_posterior(gls)
        assert np.allclose(G.linear_posterior(gls), exact) and np.allclose(G.pooled_posterior(gls), exact)
    # Pools of ploidy 3 and 1: all chromosomes are enumerated.
    gls = [np.log10(rnd.dirichlet([1, 1, 1, 1])), np.log10(rnd.dirichlet([1, 1]))]
    weight = np.zeros(5)
    for chromosomes in itertools.product((0, 1), repeat=4):
        a, b = sum(chromosomes[:3]), chromosomes[3]
        weight[a + b] += 10 ** (gls[0][a] + gls[1][b]) / math.comb(4, a + b)
    joint = np.log10(weight) + G.log10_priors(4, 1e-3)
    assert np.allclose(G.pooled_posterior(gls), joint - G.log10_sum(joint))
    flat = G.pooled_posterior(gls, priors=np.zeros(5))
    assert np.allclose(flat, np.log10(weight / weight.sum()))
    one = G.allele_count_posterior([np.array([-9.0, 0.0, -9.0])])
    quality, counts = G.independent_alleles([[np.array([-9.0, 0.0, -9.0])], [np.array([0.0, -9.0, -20.0])]])
    assert counts == [1, 0] and quality >= -10 * one[0] and quality < -10 * one[0] + 1
    assert G.calculator(2, 1) is G.allele_count_posterior and G.calculator(2, 3) is G.independent_alleles and G.calculator(4, 1) is G.pooled_posterior


def test_pools_and_errors():
    error = G.site_errors(0, 200)
    assert abs(error.sum() - 1) < 1e-9 and error.argmax() == 40 and G.site_errors(20, 200).argmax() == 10
    bases, quals = ["A"] * 15 + ["C"] * 5, [30] * 20
    assert G.pool_likelihoods(bases, quals, "A", "C", 4).argmax() == 1
    assert G.pool_likelihoods(bases, quals, "A", "C", 4, error).argmax() == 1
    assert np.allclose(G.pool_likelihoods(["A"] * 6 + ["C"] * 6, [30] * 12, "A", "C", 2), G.likelihoods(np.array([[math.log10(0.999), math.log10(0.001 / 3)]] * 6 + [[math.log10(0.001 / 3), math.log10(0.999)]] * 6)))


def test_phase_sets():
    a, b, c, d = (10, "A", "C"), (20, "G", "T"), (30, "C", "A"), (40, "T", "G")
    assert G.phase_sets([set(), {a, b}], [a, b]) == {a: (0, "0|1"), b: (0, "0|1")}
    assert G.phase_sets([{a}, {b, c}], [a, b, c]) == {a: (0, "0|1"), b: (0, "1|0"), c: (0, "1|0")}
    assert G.phase_sets([{a}, {b}, {a, b}, set()], [a, b]) == {}
    assert G.phase_sets([{a, b}, {c, d}], [a, b, c, d]) == {a: (0, "0|1"), b: (0, "0|1"), c: (0, "1|0"), d: (0, "1|0")}


GVCF = "record_id bigint, sample_name string, contig_name string, contig_position int, ref_allele string, alt string, info string, format_keys string, genotype string, qual double"


def test_joint_genotypes(spark):
    rows = [
        (1, "s1", "chr1", 100, "A", "C,<NON_REF>", "DP=9", "GT:DP:PL", "0/1:9:90,0,90,120,120,200", 1.0),
        (2, "s2", "1", 90, "A", "<NON_REF>", "END=110", "GT:DP:GQ:PL", "0/0:20:60:0,60,600", None),
        (3, "s3", "1", 100, "A", "G,<NON_REF>", None, "GT:DP:PL", "1/1:8:300,30,0,300,30,300", 1.0),
        (4, "s3", "1", 50, "A", "<NON_REF>", "END=99", "GT:DP:PL", "0/0:8:0,9,90", None),
        (5, "s4", "1", 100, "A", "C", None, "GT", "./.", None),
        (6, "s1", "??", 100, "A", "C", None, "GT:PL", "0/1:9,0,9", None),
    ]
    records = spark.createDataFrame(rows, GVCF)
    contigs = spark.createDataFrame([(0, "1", 1000)], "contig_id int, contig_name string, contig_length bigint")
    got = {(r.alt, r.sample): r for r in Q.joint_likelihoods(records, contigs).collect()}
    pl = lambda k: (got[k].pl_ref, got[k].pl_het, got[k].pl_hom, got[k].own)
    assert set(got) == {(a, s) for a in "CG" for s in ("s1", "s2", "s3", "s4")}
    assert pl(("C", "s1")) == (90, 0, 90, True) and pl(("G", "s1")) == (90, 120, 200, False) and pl(("C", "s2")) == (0, 60, 600, False)
    assert pl(("G", "s3")) == (300, 30, 0, True) and pl(("C", "s4")) == (None, None, None, True)
    called = {(r.alt, r.sample): r for r in Q.joint_genotypes(Q.joint_likelihoods(records, contigs)).collect()}
    assert called["C", "s1"].gt == "0/1" and called["C", "s1"].gq == 90 and called["C", "s4"].gt == "./." and called["G", "s3"].gt == "1/1"
    assert called["C", "s1"].ac == 1 and called["C", "s1"].an == 6 and called["G", "s1"].ac == 2 and called["C", "s1"].qual >= 30
    assert Q.joint_genotypes(Q.joint_likelihoods(records.limit(0), contigs)).count() == 0


def test_confidence_of_plain_reads(spark):
    rnd = random.Random(1)
    ref = "".join(rnd.choice("ACGT") for _ in range(300))
    rows = [(i, f"r{i}", 0, 0, "1", 100 + i % 3, 60, "60M", None, None, None, ref[99 + i % 3 : 159 + i % 3], "I" * 60, ["x"], "g") for i in range(45)]
    reads = spark.createDataFrame(rows, "record_id bigint, read_name string, flag int, contig_id int, contig_name string, contig_position int, map_q int, cigar string, mate_contig_name string, mate_position int, inferred_size int, seq string, base_quals string, attributes array<string>, read_group string")
    groups, contigs = spark.createDataFrame([("g", "s")], "read_group string, sample_name string"), spark.createDataFrame([(0, "1", 300)], "contig_id int, contig_name string, contig_length bigint")
    refs = spark.createDataFrame([("1", 0, ref.ljust(4096, "N"))], "contig string, slice bigint, seq string")
    rows = Q.with_genotype_quality(Q.likelihoods(reads, groups, contigs, refs))
    got = {r.position: r for r in rows.collect()}
    assert set(got) == set(range(100, 162)) and got[110].depth == 45 and got[110].informative == 45 and got[110].gq == 99 and got[161].informative == 0 and got[161].gq == 0
    runs = Q.blocks(rows).collect()
    assert min(r.from_position for r in runs) == 100 and sum(r.to_position - r.from_position + 1 for r in runs) == 62
    calls = spark.createDataFrame([("s", "1", 120, 121)], "sample string, contig string, from_position bigint, to_position bigint")
    cut = Q.blocks(rows, calls).collect()
    assert sum(r.to_position - r.from_position + 1 for r in cut) == 60 and any(r.to_position == 119 for r in cut) and any(r.from_position == 122 for r in cut)
