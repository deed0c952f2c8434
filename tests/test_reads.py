import random

from strandlake.kernels import reads as R

rnd = random.Random(11)


def some_read():
    ops = []
    if rnd.random() < 0.3:
        ops.append(("H", rnd.randint(1, 3)))
    if rnd.random() < 0.4:
        ops.append(("S", rnd.randint(1, 4)))
    ops.append(("M", rnd.randint(2, 9)))
    for _ in range(rnd.randint(0, 2)):
        ops += [(rnd.choice("ID"), rnd.randint(1, 3)), ("M", rnd.randint(2, 9))]
    if rnd.random() < 0.4:
        ops.append(("S", rnd.randint(1, 4)))
    n = R.read_length(ops)
    return R.Read(rnd.randint(20, 40), tuple(ops), "".join(rnd.choice("ACGT") for _ in range(n)), "".join(chr(33 + rnd.randint(0, 40)) for _ in range(n)))


def places(read):
    """(reference position or None) of each base, from the columns."""
    out, at = [], read.start
    for op in R.columns(list(read.ops)):
        if op in "MIS":
            out.append(at if op == "M" else None)
        at += op in "MDN=X"
    return out


def test_walks():
    for _ in range(300):
        r = some_read()
        where = places(r)
        assert [R.reference_position(r, i) for i in range(len(r.seq))] == where
        for i, p in enumerate(where):
            if p is not None:
                assert R.read_offset(r, p) == i


def test_cuts_keep_places():
    for _ in range(500):
        r = some_read()
        left, right = rnd.randint(0, 6), rnd.randint(0, 6)
        c = R.cut(r, left, right)
        if left + right >= len(r.seq):
            assert c.seq == ""
            continue
        assert c.seq == r.seq[left : len(r.seq) - right] and len(c.quals) == len(c.seq) == R.read_length(list(c.ops))
        kept = places(r)[left : len(r.seq) - right]
        if any(p is not None for p in kept):
            assert places(c) == kept, (r, left, right, c)


def test_clips():
    for _ in range(300):
        r = some_read()
        plain = R.without_soft_clips(r)
        assert "S" not in plain.cigar
        back = R.reverted_soft_clips(r)
        assert "S" not in back.cigar and len(back.seq) == len(r.seq)
        lo, hi = r.start + rnd.randint(0, 5), r.start + rnd.randint(5, 12)
        c = R.clipped_to(r, lo, hi)
        inside = [p for p in places(r) if p is not None and lo <= p <= hi]
        assert [p for p in places(c) if p is not None] == inside or not c.seq
        n = R.clipped_ends(r, 10, write_n=True)
        assert len(n.seq) == len(r.seq)
        assert all(ord(q) - 33 > 10 for q in R.clipped_ends(r, 10).quals[:1] + R.clipped_ends(r, 10).quals[-1:])


def test_composition():
    assert R.composed([("M", 5)], [("M", 2), ("D", 1), ("M", 3)]) == [("M", 2), ("D", 1), ("M", 3)]
    assert R.composed([("M", 2), ("I", 1), ("M", 2)], [("M", 4)]) == [("M", 2), ("I", 1), ("M", 2)]
    assert R.composed([("M", 2), ("D", 1), ("M", 2)], [("M", 2), ("I", 1), ("M", 2)]) == [("M", 4)]
    assert R.trimmed_to_reference([("M", 3), ("I", 2), ("M", 3)], 2, 4) == [("M", 1), ("I", 2), ("M", 2)]


def test_mates_and_repeats():
    a, b = R.Read.of(10, "5M", "ACGTA", "IIIII"), R.Read.of(13, "5M", "TCGTA", "IIIII")
    assert R.mended_mates(a, b) == ("III5!", "5!III")
    assert R.repeat_unit("ACAC") == "AC" and R.repeat_unit("AAA") == "A" and R.repeat_unit("ACG") == "ACG"
    assert R.tandem_repeat("GAC", "G", "ACACT") == ("AC", 3, 2)
    assert R.tandem_repeat("G", "GT", "ACG") is None
    assert R.adaptor_boundary(100, 149, 90, -60, True, True) == 89 and R.adaptor_boundary(100, 149, 90, 60, False, True) == 160
    assert R.without_adaptor(R.Read.of(10, "5M", "ACGTA", "IIIII"), 13, False).seq == "ACG"


def test_realignment():
    from strandlake.kernels import realign as A

    ref = "".join(rnd.choice("ACGT") for _ in range(300))
    event = (1149, 5, "")
    gone = A.consensus(ref, 1000, event)
    assert gone == ref[:150] + ref[155:]
    held = []
    for at in range(100, 148, 4):
        seq = gone[at : at + 60]
        held.append(R.Read(1000 + at, (("M", 60),), seq, "I" * 60))  # aligned without its deletion
    shown = R.Read(1120, (("M", 30), ("D", 5), ("M", 30)), ref[120:150] + ref[155:185], "I" * 60)
    lod, changed = A.realigned([*held, shown], ref, 1000)
    assert lod > 5 and changed
    for i, r in changed.items():
        assert A.raw_mismatches(r, ref, 1000) == 0, (i, r)
        assert R.read_length(list(r.ops)) == 60
    added = (1149, 0, "GATTACA")
    target = A.consensus(ref, 1000, added)
    for offset in range(60, 200, 7):
        start, ops = A.placed(offset, 50, added, 1000)
        read = R.Read(start, ops, target[offset : offset + 50], "I" * 50)
        for i, p in enumerate(places(read)):
            assert p is None or ref[p - 1000] == read.seq[i]
    assert A.realigned([shown], ref, 1000) == (0.0, {}) or not A.realigned([shown], ref, 1000)[1]


def test_block_wise_realignment_equals_one_group(spark):
    """The same moves as scoring all reads of a target at once, for any size of block, with a known indel that no read shows and with a deep start."""
    import random

    from strandlake.kernels import realign as A
    from strandlake.kernels import reads as K
    from strandlake.operators import realignment, reference

    rnd = random.Random(11)
    ref = "".join(rnd.choice("ACGT") for _ in range(900))
    rows, held = [], {}
    for i in range(160):
        site, gone = (400, 3) if i % 2 else (620, 2)
        start = 350 + 7 if i % 5 == 0 else rnd.randint(site - 45, site - 10)
        sample = ref[: site] + ref[site + gone :]
        seq, cigar = sample[start - 1 : start + 49], "50M"
        if site == 400 and i % 3 == 0 and site - start > 5:
            cigar = f"{site - start + 1}M{gone}D{50 - (site - start + 1)}M"
        if i % 4 == 0:
            seq = ref[start - 1 : start + 49]
            cigar = "50M"
        rows.append((i, f"r{i}", 0, 0, "1", start, 60, cigar, None, None, None, seq, "I" * 50, ["NM:i:3", "XX:i:1"], "g"))
        held[i] = K.Read.of(start, cigar, seq, "I" * 50)
    reads = spark.createDataFrame(rows, "record_id bigint, read_name string, flag int, contig_id int, contig_name string, contig_position int, map_q int, cigar string, mate_contig_name string, mate_position int, inferred_size int, seq string, base_quals string, attributes array<string>, read_group string")
    groups = spark.createDataFrame([("g", "s")], "read_group string, sample_name string")
    contigs = spark.createDataFrame([(0, "1", 900)], "contig_id int, contig_name string, contig_length bigint")
    refs = reference.slices(spark.createDataFrame([("1", i + 1, b) for i, b in enumerate(ref)], "contig string, position bigint, ref string"))
    targets = spark.createDataFrame([("1", 395, 410), ("1", 615, 630)], "contig string, start bigint, stop bigint")
    variants = spark.createDataFrame([("chr1", 620, ref[619:622], ref[619]), ("1", 5, "A", "<DEL>"), ("1", None, None, None)], "contig_name string, contig_position int, ref_allele string, alt string")
    expected = {}
    for start, stop, known in ((395, 410, []), (615, 630, [(620, 2, "")])):
        near = {i: r for i, r in held.items() if r.start <= stop and r.end >= start}
        lo = max(1, start - 230)
        window = ref[lo - 1 : min(900, stop + 230)] + "N" * max(0, stop + 230 - 900)
        lod, changed = A.realigned(list(near.values()), window, lo, known)
        ids = list(near)
        expected |= {(start, ids[k]): (r.start, r.cigar, lod) for k, r in changed.items() if (r.start, r.cigar) != (near[ids[k]].start, near[ids[k]].cigar)}
    assert len({s for s, _ in expected}) == 2
    for block in (7, 512):
        got = realignment.realigned(targets, reads, groups, contigs, refs, variants, block=block, entropy=False)
        assert {(r.start, r.record_id): (r.new_position, r.new_cigar, r.lod) for r in got.collect()} == expected
    cleaned = realignment.realigned(targets, reads, groups, contigs, refs, variants, block=16)
    assert {(r.start, r.record_id) for r in cleaned.collect()} == set(expected)
    moved = {r.record_id: r for r in realignment.with_moves(reads, cleaned).collect()}
    assert len(moved) == len(rows)
    for (_, i), (start, cigar, _) in expected.items():
        assert (moved[i].contig_position, moved[i].cigar, moved[i].map_q, moved[i].attributes) == (start, cigar, 70, ["XX:i:1"])
    assert realignment.realigned(targets, reads.limit(0), groups, contigs, refs, variants).count() == 0


def test_every_stage_of_the_germline_plan_is_read(spark):
    from conftest import SMALL

    from strandlake.plans.germline import INPUTS, germline
    from strandlake.tables import table

    plan = germline(spark, {n: table(spark, SMALL, n) for n in INPUTS})
    assert plan.unread() == {"calls"}
    assert {"realign", "recalibrate", "cut_reads"} <= plan.needed("calls")
