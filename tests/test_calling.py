import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from strandlake.kernels import assembly
from strandlake.operators import calling, pileup, reference, regions
from strandlake.tables import table

rnd = random.Random(5)
REF = "".join(rnd.choice("ACGT") for _ in range(600))


def read_row(i, at, seq, group, **more):
    """A placed read; ``at`` is 1-based."""
    row = {"record_id": i, "read_name": f"r{i}", "flag": 0, "contig_id": 0, "contig_name": "1", "contig_position": at, "map_q": 60, "cigar": f"{len(seq)}M", "mate_contig_name": None, "mate_position": None, "inferred_size": None}
    return row | {"seq": seq, "base_quals": "I" * len(seq), "attributes": [], "read_group": group, "delivery": None, "loaded_at": None} | more


def groups(spark, rows, ref=REF, start=250, stop=350):
    reads = spark.createDataFrame([tuple(r.values()) for r in rows], table(spark, SMALL, "reads").schema)
    refs = reference.slices(spark.createDataFrame([("1", i + 1, b) for i, b in enumerate(ref) if b != "N"], "contig string, position bigint, ref string"))
    found = spark.createDataFrame([("1", start, stop, 1)], "contig string, start bigint, stop bigint, activity bigint")
    return calling.region_groups(found, reads, table(spark, SMALL, "read_groups"), table(spark, SMALL, "contigs"), refs)


@pytest.fixture(scope="module")
def group(spark):
    return table(spark, SMALL, "read_groups").agg(F.min("read_group")).collect()[0][0]


def changed(ref, *at):
    """The reference with another base at 1-based positions."""
    for p in at:
        ref = ref[: p - 1] + {"A": "C", "C": "G", "G": "T", "T": "A"}[ref[p - 1]] + ref[p:]
    return ref


def test_all_reads_of_a_start_count(spark, group):
    alt = changed(REF, 300)
    rows = [read_row(i, 250, (alt if i % 3 == 0 else REF)[249:349], group) for i in range(30)]
    found = groups(spark, rows)
    assert found.count() == 30
    (one,) = calling.called(found, block=7).collect()
    assert (one.position, one.ref, one.alt, one.gt, one.depth) == (300, REF[299], alt[299], "0/1", 30)
    assert calling.called(found, block=100).collect() == [one]


def test_alleles_of_lower_paths_are_assembled(spark, group):
    *even, rare = range(250, 430, 30)
    rows = []
    for i in range(64):
        own = [p for j, p in enumerate(even) if i >> j & 1] + [rare] * (i % 4 == 0)
        rows.append(read_row(i, 200, changed(REF, *own)[199:499], group))
    found = {r.haplotype for r in calling.assembled(groups(spark, rows, start=240, stop=420)).collect()}
    assert changed(REF, rare)[139:520] in found


def test_all_stretches_of_a_reference_are_called(spark, group):
    ref = REF[:294] + "N" * 10 + REF[304:]
    alt = changed(REF, 270, 330)
    rows = [read_row(i, at + 1, (alt if i % 2 else REF)[at : at + 60], group) for i, at in enumerate([230] * 20 + [304] * 20)]
    found = groups(spark, rows, ref)
    assert {(r.position, r.alt, r.depth) for r in calling.called(found).collect()} == {(270, alt[269], 20), (330, alt[329], 20)}


def test_larger_kmers():
    ref = REF[:100] + REF[20:68] + REF[148:260]  # repeats 48 bases
    alt = ref[:180] + ("A" if ref[180] != "A" else "C") + ref[181:]
    assert {s for _, s in assembly.assemble(ref, [alt[90:], alt[90:]])} == {ref, alt}


@pytest.mark.parametrize("cigar, cut", [("30M4D30M", slice(30, 34)), ("60M", None), ("30M30S", slice(30, 34))])
def test_indels_and_clips_make_a_locus_active(spark, group, cigar, cut):
    """Reads show no other base than the reference's where they are aligned."""
    seq = REF[200:230] + REF[234:264] if cut else REF[200:260]
    rows = [read_row(i, 201, seq, group, cigar=cigar) for i in range(6)]
    reads = spark.createDataFrame([tuple(r.values()) for r in rows], table(spark, SMALL, "reads").schema)
    els = pileup.elements(reads, table(spark, SMALL, "read_groups"), table(spark, SMALL, "contigs"))
    refs = reference.slices(spark.createDataFrame([("1", i + 1, b) for i, b in enumerate(REF)], "contig string, position bigint, ref string"))
    found = regions.activity(els, reference.bases(refs))
    active = {r.position: float(r.activity) for r in found.collect()}
    want = {"30M4D30M": set(range(230, 236)), "60M": set(), "30M30S": {230}}[cigar]
    assert set(active) == want and all(4.99 < x <= 5 for x in active.values())
    parts = regions.regions(regions.smoothed(found), 10_000).collect()
    assert len(parts) == bool(want) and all(p.start <= 230 <= p.stop for p in parts)
