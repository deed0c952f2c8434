from strandlake.kernels import reads as R
from strandlake.operators import calling, compact, realignment, regions

REF = "GGCACACACATTTTTGC" + "N" * 20


def refs_of(spark):
    return spark.createDataFrame([("1", 0, REF.ljust(4096, "N"))], "contig string, slice bigint, seq string")


RECORD = "record_id bigint, contig string, contig_position int, ref_allele string, alt string"


def test_indels_against_the_reference(spark):
    rows = spark.createDataFrame([(1, "1", 9, "CA", "C"), (2, "1", 8, "ACA", "A"), (3, "1", 11, "T", "TT"), (4, "1", 3, "C", "G"), (5, "1", 3, "C", "<DEL>"), (6, "1", 30, "N", "NA"), (2, "1", 8, "ACA", "A")], RECORD)
    got = {r.record_id: (r.contig_position, r.ref_allele, r.alt) for r in compact.left_aligned(rows, refs_of(spark)).collect()}
    assert got[2] == (2, "GCA", "G") and got[3] == (10, "A", "AT") and got[4] == (3, "C", "G") and got[5][2] == "<DEL>" and len(got) == 6
    repeats = {r.record_id: (r.unit, r.ref_copies, r.alt_copies) for r in compact.tandem_repeats(spark.createDataFrame([(1, "1", 2, "GCA", "G"), (2, "1", 10, "A", "AT"), (3, "1", 3, "C", "G")], RECORD), refs_of(spark)).collect()}
    assert repeats == {1: ("CA", 4, 3), 2: ("T", 5, 6)}
    assert compact.left_aligned(rows.limit(0), refs_of(spark)).count() == 0


def test_codecs_of_odd_reads(spark):
    rows = [(1, "ACGTNRYacgt", "!~IIIIIIIII"), (2, "", ""), (3, None, None), (4, "A" * 5000, "#" * 5000)]
    reads = spark.createDataFrame(rows, "record_id int, seq string, base_quals string")
    back = {r.record_id: (r.seq, r.base_quals) for r in compact.expanded(compact.compacted(reads)).collect()}
    assert back == {i: (None if s is None else s.upper(), q) for i, s, q in rows}


def test_levelling(spark):
    rows = [(i, "g", 1) for i in range(20)] + [(100 + i, "g", 2) for i in range(5)] + [(200, "g", 3), (201, None, None), (202, None, None)]
    kept = compact.levelled(spark.createDataFrame(rows, "record_id bigint, k string, at int"), ["k"], "at", 9).collect()
    sizes = {}
    for r in kept:
        sizes[r.k, r["at"]] = sizes.get((r.k, r["at"]), 0) + 1
    assert sizes == {("g", 1): 4, ("g", 2): 4, ("g", 3): 1, (None, None): 2}


def test_merging_and_cutting_reads():
    a, b = R.Read.of(10, "6M", "ACGTAC", "IIIII5"), R.Read.of(14, "4M", "AGTT", "I?II")
    one = R.merged_mates(a, b)
    assert (one.start, one.cigar, one.seq) == (10, "8M", "ACGTAGTT") and ord(one.quals[5]) - 33 == 10
    assert R.merged_mates(a, R.Read.of(40, "4M", "AGTT", "IIII")) is None and R.merged_mates(a, R.Read.of(12, "2M1D2M", "AGTT", "IIII")) is None
    assert R.trimmed_haplotype("ACGTTAC", [("M", 3), ("I", 2), ("M", 2)], 100, 101, 103) == "CGTTA"
    assert R.with_allele("ACGT", 10, 11, "CG", "T") == "ATT" and R.with_allele("ACGT", 10, 11, "A", "T") is None
    cut = R.low_quality_soft_clips(R.Read.of(5, "3S2M2S", "ACGTACG", "#I#II##"), 10)
    assert cut.seq == "CGTA"


def test_regions_and_phases(spark):
    found = spark.createDataFrame([("1", 100, 399), ("1", 500, 599)], "contig string, start bigint, stop bigint")
    events = spark.createDataFrame([("1", 100, 200, "A", "C"), ("1", 100, 230, "AT", "A")], "contig string, start bigint, position bigint, ref string, alt string")
    got = {r.start: r for r in regions.trimmed(found, events).collect()}
    assert (got[100].from_position, got[100].to_position, got[100].left_flank, got[100].right_flank.from_position) == (100, 381, None, 382)
    assert got[500].from_position is None and got[500].left_flank.to_position == 599 and got[500].n_events == 0
    assert regions.half_width(17.0) == 50 and regions.half_width(2.0) == 9
    clips = {r.position: r.activity for r in regions.spread_clips(spark.createDataFrame([("1", 5, 2), ("1", 9, 0), ("1", 1, 1)], "contig string, position bigint, n_clips int")).collect()}
    assert clips == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    calls = spark.createDataFrame([("1", 1, 3, "G", "T", "s", "0/1", 9), ("1", 1, 6, "A", "C", "s", "0/1", 9), ("1", 1, 8, "T", "A", "s", "1/1", 9)], "contig string, start bigint, position bigint, ref string, alt string, sample string, gt string, depth int")
    haplotypes = spark.createDataFrame([("1", 1, 10, 1, "ACGTCAGT", 5, [(0.0, "ACGTCAGA", "8M"), (0.0, "ACTTCCGA", "8M")])], "contig string, start bigint, stop bigint, ref_start bigint, ref string, n_reads bigint, haplotypes array<struct<score:double,haplotype:string,cigar:string>>")
    rows = {r.position: (r.phase_set, r.phased_gt) for r in calling.phased(calls, haplotypes).collect()}
    assert rows == {3: (0, "0|1"), 6: (0, "0|1")}


def test_mates_follow_moves(spark):
    schema = "record_id bigint, read_name string, flag int, contig_name string, contig_position int, map_q int, cigar string, mate_position int, inferred_size int, attributes array<string>, read_group string"
    rows = [(1, "r/1", 65, "1", 100, 60, "10M", 150, 60, [], "g"), (2, "r/2", 129, "chr1", 150, 60, "10M", 100, -60, [], "g"), (3, "q", 65, "1", 100, 60, "10M", 150, 60, [], "g"), (4, "r", 129 | 256, "1", 9, 60, "10M", 100, -60, [], "g"), (5, "r/2", 129, "1", 150, 60, "10M", 100, -60, [], None)]
    reads, groups = spark.createDataFrame(rows, schema), spark.createDataFrame([("g", "s")], "read_group string, sample_name string")
    moves = spark.createDataFrame([("1", 90, 1, 105, "8M2D2M", 9.0)], "contig string, start bigint, record_id bigint, new_position bigint, new_cigar string, lod double")
    got = {r.record_id: r for r in realignment.with_mates_fixed(realignment.with_moves(reads, moves), moves, groups).collect()}
    assert len(got) == 5 and got[1].contig_position == 105 and got[1].mate_position == 150
    assert (got[2].mate_position, got[2].inferred_size) == (105, -55)
    assert all((got[i].mate_position, got[i].inferred_size) == (rows[i - 1][7], rows[i - 1][8]) for i in (3, 4, 5))
