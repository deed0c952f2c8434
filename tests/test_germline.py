"""The germline plan in batches: the same as one row per base and one read or target at a time; what nothing reads any more goes."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import MIDDLE, SMALL

from strandlake.kernels import realign, recalibrate
from strandlake.kernels import reads as R
from strandlake.operators import pileup, reference, regions, tallies
from strandlake.plans.germline import INPUTS, germline
from strandlake.plans.stages import Plan, Stage
from strandlake.session import drop_staged, staged
from strandlake.tables import table


def _bag(df, columns):
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


def test_activity_on_a_given_reference_and_indels_without_rows_per_base(spark):
    tables = [table(spark, MIDDLE, n) for n in ("reads", "read_groups", "contigs")]
    rows = staged(pileup.read_rows(*tables), "rows")
    refs = staged(reference.read_slices(rows), "refs")
    assert _bag(refs, refs.columns) == _bag(reference.slices(tallies.consensus(tallies.position_counts(*tables))), refs.columns)
    changed = staged(refs.selectExpr("contig", "slice", "translate(seq, 'AC', 'cN') as seq"), "changed")  # no consensus: lower case, and gaps
    els = pileup.elements(*tables)
    got = regions.activity_on(rows, changed, reference.SLICE).selectExpr("contig", "position", "cast(milli * 0.001 as decimal(10,3)) as activity")
    want = _bag(regions.activity(els, reference.bases(changed)), ["contig", "position", "activity"])
    assert len(want) > 1000
    assert _bag(got, ["contig", "position", "activity"]) == want
    variants = table(spark, MIDDLE, "variants")
    columns = ["contig", "start", "stop"]
    assert _bag(regions.indel_events(pileup.indels(rows), variants), columns) == _bag(regions.indel_events(els, variants), columns)


def test_the_plan_makes_no_row_per_base_and_leaves_no_staged_table(spark):
    plan = germline(spark, {n: table(spark, SMALL, n) for n in INPUTS})
    called = []
    before = pileup.aligned_bases
    pileup.aligned_bases = lambda *a, **k: called.append("rows per base") or before(*a, **k)
    try:
        result = plan.result("calls")
    finally:
        pileup.aligned_bases = before
    assert called == []
    left = {n for n in plan.tables.held if n not in INPUTS}
    assert not left & {o for s in plan.stages.values() if s.staged for o in s.outputs}
    columns = ["contig", "start", "position", "ref", "alt", "sample", "gt", "depth", "pl", "qual"]
    other = germline(spark, {n: table(spark, SMALL, n) for n in INPUTS}).run()["calls"]
    assert _bag(result, columns) == _bag(other, columns)


def test_a_staged_table_goes_only_after_all_that_read_it(spark):
    ids = staged(spark.range(3), "ids")
    plan = Plan(spark, {"given": ids})
    keep = {"fusible": False, "detached": True, "staged": True}
    plan.add(Stage("first", ("given",), ("a",), lambda t: staged(t, "a"), **keep))
    plan.add(Stage("second", ("a",), ("b",), lambda t: staged(t.selectExpr("id + 1 as id"), "b"), **keep))
    plan.add(Stage("lazy", ("a",), ("c",), lambda t: t))
    plan.add(Stage("last", ("b", "c"), ("d",), lambda b, c: b.join(c, "id")))
    assert plan.readers("a") == {"second", "d"}
    assert sorted(r.id for r in plan.result("d").collect()) == [1, 2]
    assert ids.count() == 3
    with pytest.raises(ValueError):
        drop_staged(table(spark, SMALL, "contigs"))
    drop_staged(ids)


def test_qualities_of_many_counts_are_those_of_each():
    rnd = random.Random(3)
    n = np.array([rnd.choice([0, 1, 5, 100, 10**4, 10**7, 3 * 10**9]) for _ in range(500)], float)
    errors = np.array([rnd.randint(0, int(min(x, 5000))) for x in n], float)
    reported = np.array([rnd.choice([2, 20, 30, 30 - 1e-12, 30 + 1e-12, 40.5, 93]) for _ in n], float)
    assert recalibrate.bayesian_qualities(n, errors, reported).tolist() == [recalibrate.bayesian_quality(*x) for x in zip(n, errors, reported, strict=True)]


def test_places_and_mended_mates_are_those_of_a_walk_base_by_base():
    rnd = random.Random(4)
    ref = "".join(rnd.choice("ACGTN" if i % 40 == 0 else "ACGT") for i in range(260))
    for _ in range(200):
        start = rnd.randint(1, 200)
        pair = []
        for cigar in rnd.sample(["30M", "10M2D20M", "12M3I15M", "4S20M6S", "8M5N22M"], 2):
            pair.append(R.Read.of(start + rnd.randint(0, 20), cigar, "".join(rnd.choice("ACGT") for _ in range(30)), "".join(rnd.choice("!+5I") for _ in range(30))))
        read = pair[0]
        sums = realign.mismatch_sums(read.seq, read.quals, ref, np.arange(len(ref) - 29))
        at = int(np.lexsort((np.abs(np.arange(len(sums)) - (read.start - 1)), sums))[0])
        assert realign.best_place(read, ref, 1) == (at, int(sums[at]))
        want = [list(r.quals) for r in pair]
        for position in range(1, 300):
            i, j = (R.read_offset(r, position) for r in pair)
            if i is not None and j is not None and [R.reference_position(r, k) for r, k in zip(pair, (i, j), strict=True)] == [position] * 2:
                same = pair[0].seq[i] == pair[1].seq[j]
                want[0][i], want[1][j] = (min(want[0][i], "5"), min(want[1][j], "5")) if same else ("!", "!")
        assert R.mended_mates(*pair) == tuple("".join(q) for q in want)
