"""Walks over bins of reads: one block or many give the same, and queries make no row per base."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from strandlake.operators import annotations, contexts, pileup, recal, somatic, tallies, walks
from strandlake.queries import registry
from strandlake.queries.somatics import _tumor_reads
from strandlake.tables import table


def _reads(n: int = 600, seed: int = 3) -> pa.RecordBatch:
    """Reads of two contigs and three bins, one of them deep, with indels, clips and texts that are missing or too short."""
    rng = np.random.default_rng(seed)
    contig = np.sort(rng.choice(["1", "2"], n))
    bins = np.where(contig == "1", np.where(np.arange(n) < n // 8, 0, 1), 0)
    starts = bins * walks.WIDTH + rng.integers(1, 40, n)
    cigars = rng.choice(["20M", "8M2I10M", "9M3D11M", "3S17M", "12M5N8M"], n)
    seqs = ["".join(rng.choice(list("ACGTNacgt"), 20, p=[0.4, 0.3, 0.1, 0.1, 0.02, 0.02, 0.02, 0.02, 0.02])) for _ in range(n)]
    quals = [None if i % 17 == 0 else "*" if i % 19 == 0 else "I" * 10 if i % 23 == 0 else "".join(map(chr, rng.integers(34, 75, 20))) for i in range(n)]
    who = rng.integers(0, 3, n)
    columns = {
        "contig": pa.array(contig), "contig_position": pa.array(starts), "cigar": pa.array(cigars), "seq": pa.array(seqs), "base_quals": pa.array(quals, pa.string()), "map_q": pa.array([None if i % 29 == 0 else int(x) for i, x in enumerate(rng.integers(0, 61, n))], pa.int32()), "is_reverse": pa.array(rng.integers(0, 2, n), pa.int32()),
        "is_t": pa.array((who == 1).astype(np.int32)), "is_n": pa.array((who == 2).astype(np.int32)), "read_length": pa.array(np.full(n, 20, np.int32)), "sample": pa.array([None if i % 31 == 0 else f"s{x}" for i, x in enumerate(who)]), "read_start": pa.array(starts), "record_id": pa.array(rng.permutation(n)), "bin": pa.array(bins),
    }
    return pa.RecordBatch.from_pydict(columns)


def _walk(function, rows: pa.RecordBatch, size: int) -> list:
    batches = [rows.slice(at, size) for at in range(0, rows.num_rows, size)]
    found = [x for bins in walks._whole_bins(iter(batches), walks.WIDTH) for x in function(bins)]
    return sorted((tuple(round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in row.values()) for batch in found for row in batch.to_pylist()), key=repr)


WALKS = {"candidates": somatic._candidates_of, "offsets": somatic._offsets_of, "samples": annotations._sample_tables_of, "by_start": lambda bins: contexts._by_start(bins, 100)}


@pytest.mark.parametrize("name", sorted(WALKS))
def test_deep_bins_come_in_blocks(name, monkeypatch):
    """A deep bin, decoded block by block from its file, gives what one block gives."""
    rows = _reads()
    whole = _walk(WALKS[name], rows, 1000)
    monkeypatch.setattr(walks, "BLOCK", 16)
    monkeypatch.setattr(walks, "HELD_READS", 40)
    assert len(whole) > 20 and _walk(WALKS[name], rows, 37) == whole


def test_candidates_as_from_elements(spark):
    rows, tumor, normal = _tumor_reads(spark, SMALL)
    tables = [table(spark, SMALL, n) for n in ("reads", "read_groups", "contigs")]
    want = somatic.candidates(pileup.elements(*tables), tallies.consensus(tallies.position_counts(*tables)), tumor, normal)
    got = somatic.read_candidates(rows, tumor, normal)
    assert dict(got.dtypes) == dict(want.dtypes)
    bag = lambda df: sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.select(got.columns).collect()), key=repr)
    assert bag(got) == bag(want) and got.count() > 100


def test_rejections_as_from_elements(spark):
    rows, tumor, normal = _tumor_reads(spark, SMALL)
    tables = [table(spark, SMALL, n) for n in ("reads", "read_groups", "contigs")]
    judged = somatic.judged(somatic.candidates(pileup.elements(*tables), tallies.consensus(tallies.position_counts(*tables)), tumor, normal), recal.known_sites(table(spark, SMALL, "variants")))
    want = judged.groupBy(F.concat_ws(",", "reasons").alias("reasons"), "reported", "kept").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, registry.queries()["somatic_rejections"](spark, SMALL).collect())) == sorted(map(tuple, want.collect()))


#: Queries that once made a row per base and joined those by position.
WITHOUT_BASES = ["annotated_samples", "best_candidates", "candidate_offsets", "context_by_start", "mismatch_windows", "read_mismatches", "somatic_lod", "somatic_rejections"]


@pytest.mark.parametrize("name", WITHOUT_BASES)
def test_no_row_per_base(spark, name):
    """Reads are only copied to the bins that they overlap."""
    plan = registry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") <= 1, plan
