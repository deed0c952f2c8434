"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import pytest
from conftest import SMALL
from oracle import differences

from strandlake.queries import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    _, ours, theirs = differences(QUERIES[name](spark, SMALL), duck, ORACLES[name])
    assert not ours and not theirs, (ours, theirs)


#: Queries whose plans lean most on the optimizer; they are compared once more as they ship, with generated code and adaptive plans.
AS_SHIPPED = ["p1_rejects", "p2_site_stats", "p3_found", "dedup_bin_counts", "range_join_overlap", "interval_merge_all", "coverage_depth", "pileup_counts", "strand_table", "recal_table_2", "gvcf_blocks", "joint_likelihoods", "somatic_lod", "rank_sum_z"]


@pytest.mark.parametrize("name", AS_SHIPPED)
def test_same_rows_as_shipped(shipped, duck, name):
    _, ours, theirs = differences(QUERIES[name](shipped, SMALL), duck, ORACLES[name])
    assert not ours and not theirs, (ours, theirs)


#: Without SQL: columns that must be there, one that identifies a row, and the smallest number of rows on these tables.
WITHOUT_SQL = {
    "active_region_reads": (["contig", "start", "stop", "n_reads"], ["contig", "start"], 1),
    "af_exact": (["contig", "contig_position", "alt", "qual", "alt_count", "n_samples"], ["contig", "contig_position", "ref_allele", "alt"], 1),
    "alignment_quality": (["record_id", "baq"], ["record_id"], 1),
    "finalized_reads": (["record_id", "start", "cigar", "seq", "base_quals"], ["record_id"], 100),
    "hardy_weinberg": (["contig", "contig_position", "hwp"], ["contig", "contig_position"], 1),
    "mended_mates": (["record_id", "base_quals"], ["record_id"], 1),
    "recal_apply": (["qual", "new_qual", "n"], ["qual", "new_qual"], 10),
    "reference_confidence": (["sample", "contig", "position", "gq", "pl"], ["sample", "contig", "position"], 1000),
    "confidence_blocks": (["sample", "contig", "from_position", "to_position"], ["sample", "contig", "from_position"], 10),
    "quantize_levels": (["quality", "quantized"], ["quality"], 94),
    "sw_align": (["record_id", "position", "cigar", "score"], ["record_id"], 1),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    if name in WITHOUT_SQL:
        columns, key, least = WITHOUT_SQL[name]
        assert len(rows) >= least and all(c in rows[0].asDict() for c in columns)
        assert len({tuple(r[k] for k in key) for r in rows}) == len(rows)


def test_core_needs_no_llm():
    import pathlib

    import strandlake

    root = pathlib.Path(strandlake.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "strandlake.llm" not in path.read_text(), path
