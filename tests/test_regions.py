"""Active regions, assembly, alignment and scoring in batches: the same as one row per base, and as one pair at a time; no row per base is made."""

import random

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from strandlake.kernels import align, assembly, genotype
from strandlake.operators import calling, pileup, reference, regions, tallies
from strandlake.queries import callers, somatics
from strandlake.session import staged
from strandlake.tables import table

LIGHT_SIZES = (*assembly.KMER_SIZES, *assembly.LARGER_SIZES)


def _tables(spark):
    return [table(spark, SMALL, n) for n in ("reads", "read_groups", "contigs")]


def _bag(df, columns=None):
    return sorted((tuple(r) for r in df.select(columns or df.columns).collect()), key=repr)


def test_activity_and_regions_as_from_elements(spark):
    """Whole numbers in thousandths, and runs over the edges of bins, of any width."""
    tables = _tables(spark)
    want = staged(regions.activity(pileup.elements(*tables), tallies.consensus(tallies.position_counts(*tables))), "activity")
    got = staged(regions.read_activity(pileup.read_rows(*tables)), "read-activity")
    assert _bag(got.select("contig", "position", (F.col("milli") / 1000).cast("decimal(10,3)").alias("activity"))) == _bag(want)
    cut = _bag(regions.regions(regions.smoothed(want), 10_000), ["contig", "start", "stop", "activity"])
    assert len(cut) > 50
    for width in (1 << 14, 256):
        assert _bag(regions.active_runs(got, 10_000, width=width), ["contig", "start", "stop", "activity"]) == cut


def test_slices_of_reads_as_of_bases(spark):
    tables = _tables(spark)
    want = _bag(reference.slices(tallies.consensus(tallies.position_counts(*tables)), 256), ["contig", "slice", "seq"])
    assert _bag(reference.read_slices(pileup.read_rows(*tables), 256), ["contig", "slice", "seq"]) == want


def test_regions_without_rows_per_base(spark):
    """Before, each read was exploded into its bases, and each locus into the positions around it."""
    found = regions.read_activity(pileup.read_rows(*_tables(spark)))._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("Generate ") == 1
    assert "explode(sequence(0" not in somatics.active_regions(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_calls_need_no_python_call_per_group(spark):
    groups = staged(callers._groups(spark, SMALL), "groups")
    for df in (calling.assembled(groups), calling.called(groups)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and "FlatMapCoGroupsInPandas" not in plan


def test_blocks_of_reads_add_up(spark):
    groups = staged(callers._groups(spark, SMALL), "groups")
    whole = _bag(calling.called(groups))
    assert whole and _bag(calling.called(groups, block=2)) == whole


def _changed(rng, text, letters, most):
    q = list(text)
    for _ in range(rng.randint(1, most)):
        j, o = rng.randrange(len(q) + 1), rng.random()
        if o < 0.4 and j < len(q):
            q[j] = rng.choice(letters)
        elif o < 0.7:
            q[j:j] = [rng.choice(letters) for _ in range(rng.randint(1, 3))]
        else:
            del q[j : j + rng.randint(1, 3)]
    return "".join(q)


@pytest.mark.parametrize("costs", [align.HAPLOTYPE_COSTS, align.REALIGN_COSTS])
def test_many_whole_alignments_as_one_by_one(costs):
    rng, pairs = random.Random(2), []
    for i in range(1500):
        letters = "ACGT" if i % 2 else "AC"
        ref = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
        if query := _changed(rng, ref, letters, 4):
            pairs.append((ref, query))
    want = [align.smith_waterman(r, q, costs, overhang="indel")[1] for r, q in pairs]
    assert align.whole_alignments(pairs, costs) == want and align.whole_alignments(pairs, costs, cells=600) == want


def test_only_reference_is_what_the_graphs_say(monkeypatch):
    """Where no graph is built, the graphs give just the reference."""
    rng, light = random.Random(5), 0
    for i in range(400):
        letters = "ACGT" if i % 3 else "AC"
        ref = "".join(rng.choice(letters) for _ in range(rng.randint(15, 60)))
        reads = {}
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(len(ref))
            text = _changed(rng, ref[a : rng.randrange(a, len(ref)) + 1], letters, 2) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
            if text:
                reads[text] = rng.randint(1, 2)
        reads = sorted(reads.items())
        for sizes in ((4, 7, 9, 11), LIGHT_SIZES):
            if assembly.only_reference(ref, reads, sizes):
                light += 1
                with monkeypatch.context() as m:
                    m.setattr(assembly, "only_reference", lambda *_: False)
                    assert assembly.assemble(ref, reads, sizes[:2], larger=sizes[2:]) == [(0.0, ref)]
    assert light > 100


def test_cycles_beside_the_reference():
    for reads in (["ACGTTGCAAC", "GGTTTCC"], ["CAACGTTT", "TTTGGTACG"], ["GTACGTAC"], ["TTGCACGT"]):
        ref, k = "TACGTTGCAACGGT", 4
        graph = assembly.KmerGraph(k)
        graph.add(ref, is_ref=True)
        for r in reads:
            graph.add(r)
        place = {ref[i : i + k]: i for i in range(len(ref) - k + 1)}
        assert graph.leaves_and_returns(place) == graph.has_cycle(), reads


def test_scores_of_many_blocks_as_of_one():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    blocks = []
    for _ in range(8):
        reads = [text(rng.randint(0, 30)) for _ in range(rng.randint(0, 5))]
        blocks.append((reads, [[rng.randint(6, 40) for _ in r] for r in reads], [text(rng.randint(0, 50)) for _ in range(rng.randint(1, 4))]))
    for chunk in (3, 512):
        for got, block in zip(align.pair_hmm_matrices(blocks, chunk=chunk), blocks, strict=True):
            want = np.array([[align.pair_hmm(r, q, h) for h in block[2]] for r, q in zip(*block[:2], strict=True)]).reshape(got.shape)
            assert np.array_equal(got, want)


def test_site_qualities_as_one_by_one():
    rng = np.random.default_rng(4)
    many = [1, 3, 2, 1, 5]
    gls = -rng.random((sum(many), 3)) * 9
    qual, count = genotype.site_qualities(np.repeat(np.arange(len(many)), many), gls)
    want = [genotype.site_quality(list(x)) for x in np.split(gls, np.cumsum(many)[:-1])]
    assert np.allclose(qual, [q for q, _ in want]) and count.tolist() == [c for _, c in want]
