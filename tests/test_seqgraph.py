import random

from strandlake.kernels import align, assembly
from strandlake.kernels import seqgraph as S


def graph_of(ref, reads, k=5):
    g = assembly.KmerGraph(k)
    g.add(ref, is_ref=True)
    for r in reads:
        g.add(r, times=3)
    return g


REF = "ACGTTGCAAGCTTACCGGATTCAGGCTAACGTCCATGA"


def test_reference_and_cleaning():
    g = graph_of(REF, ["TTTTT" + REF[:12], REF[-12:] + "CCCCC", "GGGGAGGGGT"])
    assert S.reference_bases(g, REF[:5]) == REF and S.has_reference_path(g, REF[:5], REF[-5:]) and not S.has_reference_path(g, REF[:5], REF[3:8])
    S.drop_beyond_reference(g, REF[:5], REF[-5:])
    assert not g.before[REF[:5]] and not g.after[REF[-5:]]
    S.drop_other_components(g, REF[:5])
    assert "GGGGA" not in {v for e in g.weight for v in e} and "GGGGA" in S.orphans(g)
    g = graph_of(REF, [REF[:15] + "TTTTTTT"])
    S.drop_unconnected_paths(g, REF[:5], REF[-5:])
    assert [t for _, t in g.best_paths(REF[:5], REF[-5:])] == [REF]


def test_dangling_ends():
    snp = REF[:20] + "G" + REF[21:]
    assert REF[20] != "G"
    tail = graph_of(REF, [snp[:34]])
    assert REF[-5:] in tail.sinks() and len(tail.sinks()) == 1  # it meets the reference by itself
    short = graph_of(REF, [snp[:23]])  # ends three bases after its difference, before its k-mers are the reference's
    assert len(short.sinks()) == 2
    assert S.recover_dangling(short, REF, least=2) == 1
    assert snp in [t for _, t in short.best_paths(REF[:5], REF[-5:])]
    deletion = REF[:18] + REF[21:24]
    g = graph_of(REF, [deletion])
    if len(g.sinks()) > 1 and S.recover_dangling(g, REF, least=3):
        assert REF[:18] + REF[21:] in [t for _, t in g.best_paths(REF[:5], REF[-5:])]
    head = graph_of(REF, [snp[17:]])
    assert S.recover_dangling(head, REF) in (0, 1)
    assert S.longest_suffix_match("ACGTAC", "GTA", 4) == 3 and S.longest_suffix_match("ACGTAC", "TTA", 4) == 2 and S.longest_suffix_match("ACGTAC", "C", 0) == 0


def test_simplifying_keeps_what_is_spelled():
    rnd = random.Random(6)
    for _ in range(30):
        ref = "".join(rnd.choice("ACGT") for _ in range(50))
        reads = []
        for _ in range(3):
            at = rnd.randint(10, 35)
            reads.append(ref[:at] + rnd.choice(["A", "C", "G", "T", "", "AT"]) + ref[at + rnd.randint(0, 2) :])
        g = graph_of(ref, reads, k=7)
        if g.has_cycle():
            continue
        seq = S.to_sequences(g)
        before, n = seq.spelled(), len(seq.text)
        after = seq.simplify()
        assert after.spelled() == before and len(after.text) <= n
        for text in before:
            path = after.route(text)
            assert path is not None and "".join(after.text[v] for v in path) == text
        assert after.route(ref + "A") is None


def test_parts_of_simplification():
    g = S.SeqGraph()
    a, b, c, d = g.add("AA"), g.add("CGT"), g.add("TGT"), g.add("GG")
    for x in (b, c):
        g.link(a, x, 2)
        g.link(x, d, 2)
    assert g.split_common_suffix(d) and g.spelled() == {"AACGTGG", "AATGTGG"} and "GT" in g.text.values()
    g = S.SeqGraph()
    a, b, c, d = g.add("AA"), g.add("CG"), g.add("CG"), g.add("T")
    for x in (b, c):
        g.link(a, x, 1, True)
        g.link(x, d, 1)
    assert g.merge_twins(d) and g.spelled() == {"AACGT"} and g.edges[a, b] == (2, True)
    assert g.zip_chains() and list(g.text.values()) == ["AACGT"]
    assert S.unique_best([(-1.0, "A"), (-0.5, "A"), (-2.0, "C")], 1) == [(-0.5, "A")]


def test_error_correction_and_edge_alignment():
    rnd = random.Random(3)
    truth = "".join(rnd.choice("ACGT") for _ in range(60))
    wrong = truth[:30] + ("A" if truth[30] != "A" else "C") + truth[31:]
    out = S.corrected([truth] * 25 + [wrong], k=11)
    assert out == [truth] * 26
    assert S.corrected([truth] * 25 + [wrong] * 5, k=11)[-1] == wrong  # seen too often for an error
    middle = lambda r, q: align.smith_waterman(r, q, overhang="indel")[1]
    assert S.edge_alignment("ACGTACGT", "ACGTACGT", middle) == [("M", 8)]
    assert S.edge_alignment("ACGTACGT", "ACGACGT", middle) == [("M", 3), ("D", 1), ("M", 4)]
    assert S.edge_alignment("ACGACGT", "ACGTTACGT", middle) == [("M", 3), ("I", 2), ("M", 4)]
    for _ in range(50):
        ref = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(1, 20)))
        query = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(1, 20)))
        ops = S.edge_alignment(ref, query, middle)
        assert sum(n for op, n in ops if op in "MD") == len(ref) and sum(n for op, n in ops if op in "MIS") == len(query)
