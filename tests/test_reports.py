import random

import pytest

from strandlake.kernels import covariates as K
from strandlake.operators import readchecks, recal
from strandlake.sources import reports as R

#: Observations and errors of one read group in the four parts of a published run, and in its merge.
PARTS = [(77250207, 275689.26), (78758028, 270821.24), (80820646, 264900.68), (80845007, 262582.65)]
MERGED = (317673888, 1073993.83)


def test_report_text():
    table = R.ReportTable("T", [("Name", "%s"), ("N", "%d"), ("X", "%.2f")], "what it is", [["a b", 3, 1.5], ["long name", 10, -2.25], ["c", 200, None]])
    report = R.Report()
    report.add(table)
    text = report.text()
    assert text.splitlines()[:4] == ["#:GATKReport.v1.1:1", "#:GATKTable:3:3:%s:%d:%.2f:;", "#:GATKTable:T:what it is", "Name       N    X    "]
    back = R.Report.parse(text)
    assert back.tables["T"].rows == table.rows and back.tables["T"].columns == table.columns and back.text() == text
    assert table.find("c") == 2 and table.find("a b", 3) == 0 and table.find("q") == -1
    table.increment(0, "N")
    table.increment(3, "N")
    assert table.get(0, "N") == 4 and table.rows[3] == [None, 1, None]
    other = R.ReportTable("T", table.columns, "", [["z", 1, 1.0]])
    table.concat(other)
    assert [r[0] for r in table.sorted()] == [None, "a b", "c", "long name", "z"] and table.sorted("none") is table.rows
    with pytest.raises(ValueError, match="different columns"):
        table.concat(R.ReportTable("T", [("Name", "%s")]))
    with pytest.raises(ValueError, match="already"):
        report.add(R.ReportTable("T", []))
    for broken in ("", "x", "#:GATKReport.v1.1:1\n", "#:GATKReport.v1.1:1\n#:GATKTable:1:2:%s:;\n#:GATKTable:T:\nA\nb\n"):
        with pytest.raises((ValueError, IndexError)):
            R.Report.parse(broken)


def test_gathered_counts_of_a_published_run(spark):
    schema = "level int, read_group string, qual int, covariate string, value string, event string, observations bigint, errors double, reported double, empirical double"
    parts = [spark.createDataFrame([(0, "unit1", None, None, None, "M", n, e, 27.85, 25.0), (1, "unit1", 8, None, None, "M", n, e, None, 9.0)], schema) for n, e in PARTS]
    rows = {r.level: r for r in R.gathered(parts).collect()}
    assert rows[0].observations == MERGED[0] and round(rows[0].errors, 2) == MERGED[1] and rows[0].empirical == 25.0
    assert rows[1].observations == MERGED[0] and abs(rows[1].reported - 8) < 1e-9


def test_repeats():
    assert K.repeat_at("ACGTTTTT", 2) == ("T", 5)
    assert K.repeat_at("ACACACAC", 1) == ("AC", 4)
    assert K.repeat_at("ACACACAC", 7) == ("AC", 4)
    assert K.repeat_at("A" * 50, 10) == ("A", 20)
    assert K.repeat_at("G", 0) == ("G", 1)
    assert K.repeat_at("TTTTG", 4)[0] == "G"


def test_indel_flags_and_fractions():
    assert K.indel_flags([("M", 3), ("I", 2), ("M", 2), ("D", 4), ("M", 1)], 8, False) == ([0, 0, 1, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 1, 0])
    assert K.indel_flags([("M", 3), ("I", 2), ("M", 2), ("D", 4), ("M", 1)], 8, True) == ([0, 0, 0, 0, 0, 1, 0, 0], [0, 0, 0, 0, 0, 0, 0, 1])
    assert K.fractional_errors([1, 0, 0, 1], "@@@@") == [1, 0, 0, 1]
    assert K.fractional_errors([0, 1, 0, 0, 1], "@@AA@") == [0, 0.5, 0.5, 0.5, 0.5]
    assert K.fractional_errors([0, 1], "AA") == [0.5, 0.5]
    rnd = random.Random(2)
    for _ in range(200):
        n = rnd.randint(1, 30)
        errors, marks = [rnd.randint(0, 1) for _ in range(n)], "".join(rnd.choice("@@@A") for _ in range(n))
        shared = K.fractional_errors(errors, marks)
        assert len(shared) == n and all(0 <= x <= 1 for x in shared)


def test_colours(spark):
    assert K.colour_bases("T0123") == "TGAT" and K.colour_bases("A.0") == "NN"
    assert K.colour_inconsistencies("TGAA", "T0123") == [0, 0, 0, 1]
    reads = spark.createDataFrame([(1, "a", 0, "TGAA", ["CS:Z:T0123"], "g"), (2, "b", 16, "TTCA", ["CS:Z:T0123"], "g"), (3, "c", 0, "TGAA", [], "h"), (4, "d", 0, "TGAA", None, "g")], "record_id int, read_name string, flag int, seq string, attributes array<string>, read_group string")
    groups = spark.createDataFrame([("g", "SOLiD"), ("h", "illumina")], "read_group string, platform string")
    assert {r.record_id: r.inconsistent for r in readchecks.colour_checked(reads, groups, "leave").collect()} == {1: [3], 2: [3], 3: None, 4: None}
    assert readchecks.colour_checked(reads, groups, "drop").count() == 3
    with pytest.raises(Exception, match="no colours"):
        readchecks.colour_checked(reads, groups).collect()


def test_encoding_and_chains(spark):
    rows = spark.createDataFrame([("a", "II"), ("b", "~I"), ("c", "*"), ("d", None)], "read_name string, base_quals string")
    fixed = {r.read_name: r.base_quals for r in readchecks.checked_encoding(rows, fix=True).collect()}
    assert fixed == {"a": "**", "b": "_*", "c": "*", "d": None}
    with pytest.raises(Exception, match="above the highest one in read b"):
        readchecks.checked_encoding(rows).collect()
    steps = [(lambda d: d.selectExpr("concat(read_name, '2') AS read_name"), "last"), (lambda d: d.selectExpr("concat(read_name, '1') AS read_name"), "any"), (lambda d: d.selectExpr("concat(read_name, '0') AS read_name"), "first")]
    assert sorted(r.read_name for r in readchecks.transformed(rows, steps).collect())[0] == "a012"
    with pytest.raises(ValueError, match="one first"):
        readchecks.transformed(rows, [steps[0], steps[0]])
    fractions = readchecks.with_fractional_errors(spark.createDataFrame([([0, 1], "@A")], "errors array<int>, certainty string")).collect()[0].fractions
    assert fractions == [0.5, 0.5]
    repeats = readchecks.with_repeats(spark.createDataFrame([("aacc",), (None,)], "seq string")).collect()
    assert repeats[0].repeat_units == ["A", "C", "C", "C"] and repeats[1].repeat_units == []


def test_long_reads_and_cycles_are_counted(spark):
    """Reads longer than the slices overlap, and cycles beyond the largest: nothing gets lost."""
    n = 700
    reads = spark.createDataFrame([(1, "r", 0, 0, "1", 1, 60, f"{n}M", None, None, None, "ACGT" * (n // 4), "I" * n, ["x"], "g"), (2, "s", 0, 0, "1", 3, 60, "8M", None, None, None, "GTACGTAG", "I" * 8, ["x"], "g")], "record_id bigint, read_name string, flag int, contig_id int, contig_name string, contig_position int, map_q int, cigar string, mate_contig_name string, mate_position int, inferred_size int, seq string, base_quals string, attributes array<string>, read_group string")
    groups, contigs = spark.createDataFrame([("g", "s")], "read_group string, sample_name string"), spark.createDataFrame([(0, "1", 9000)], "contig_id int, contig_name string, contig_length bigint")
    refs = spark.createDataFrame([("1", 0, ("ACGT" * 2000)[:4096])], "contig string, slice bigint, seq string")
    sites = spark.createDataFrame([("1", 5), ("1", 650)], "contig string, position bigint")
    counts = recal.counted(recal.reads_on_reference(reads, groups, contigs, refs, sites))
    total = counts.where("covariate is null").agg({"observations": "sum", "errors": "sum"}).collect()[0]
    assert total["sum(observations)"] == n - 2 + 7 and total["sum(errors)"] == 1
    cycles = counts.where("covariate = 'Cycle'").groupBy("value").sum("observations").collect()
    assert sum(r[1] for r in cycles) == n - 2 + 7 and {r.value: r[1] for r in cycles}[None] == n - 500 - 1
