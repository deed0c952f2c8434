import random

import pytest

from strandlake.operators import rejects as R

CONTIGS = {"1": ("1", 1000), "MT": ("MT", 50), "X": ("X", 300)}
GOOD = ["1", "10", ".", "A", "C", "50", "PASS", "DP=1"]


def judge(*fields, **changed):
    row = list(fields) or list(GOOD)
    for k, v in changed.items():
        row[["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"].index(k)] = v
    try:
        R.vcf_record("\t".join(row), CONTIGS)
    except R.Rejected as e:
        return str(e)
    return None


@pytest.mark.parametrize(
    ("changed", "reason"),
    [
        ({}, None),
        ({"chrom": "chr1"}, None),
        ({"chrom": "CHRM"}, None),
        ({"chrom": " 1"}, "contig"),
        ({"chrom": "Z"}, "contig"),
        ({"pos": "0"}, "position"),
        ({"pos": "1000"}, None),
        ({"pos": "1001"}, "position"),
        ({"pos": "0010"}, None),
        ({"pos": "9" * 5000}, "position"),
        ({"pos": "1e2"}, "position"),
        ({"pos": "１"}, "position"),
        ({"ref": "acgtn"}, None),
        ({"ref": "AU"}, "ref"),
        ({"alt": "."}, None),
        ({"alt": "C,*,<DEL>,<A:b_1>"}, None),
        ({"alt": "C,"}, "alt"),
        ({"alt": "<1>"}, "alt"),
        ({"alt": "C,c"}, "alt_repeated"),
        ({"alt": "a"}, "alt_repeated"),
        ({"alt": "C,."}, "alt"),
        ({"qual": "."}, None),
        ({"qual": "1.5e-3"}, None),
        ({"qual": "1."}, "qual"),
        ({"qual": "NaN"}, "qual"),
        ({"qual": "-1"}, "qual"),
        ({"id": ""}, "empty_field"),
        ({"info": '"a\tb"'}, None),
        ({"info": '"a""b"'}, None),
        ({"info": 'a"b'}, "quote"),
        ({"info": '"a'}, "quote"),
        ({"info": '"a"b'}, "quote"),
        ({"info": '""'}, "empty_field"),
        ({"info": '"'}, "quote"),
        ({"info": "x\ry\nz"}, None),
        ({"info": '"x\ny"'}, None),
        ({"info": "\0"}, None),
        ({"info": "k" * 300_000}, None),
        ({"info": '"' + "k\t" * 200_000 + '"'}, None),
    ],
)
def test_vcf(changed, reason):
    assert judge(**changed) == reason


def test_vcf_counts():
    assert judge(*GOOD, "GT") == "field_count"
    assert judge(*GOOD, "GT", "0/1") is None
    assert judge("EOF") == "field_count"


def test_quoted_values():
    fields = R.split_record('a\t"b\tc"\t"d""e"\t"x\ny"\tf')
    assert fields == ["a", "b\tc", 'd"e', "x\ny", "f"]


def test_split_against_brute_force():
    """A state machine by the format's words agrees with the reader on random texts."""

    def brute(text):
        fields, i = [], 0
        while True:
            if text[i : i + 1] == '"':
                value, i = "", i + 1
                while True:
                    if i >= len(text):
                        return None
                    if text[i] == '"':
                        if text[i + 1 : i + 2] == '"':
                            value, i = value + '"', i + 2
                            continue
                        i += 1
                        break
                    value, i = value + text[i], i + 1
                if i < len(text) and text[i] != "\t":
                    return None
            else:
                value = ""
                while i < len(text) and text[i] != "\t":
                    if text[i] == '"':
                        return None
                    value, i = value + text[i], i + 1
            fields.append(value)
            if i >= len(text):
                return fields
            i += 1

    rnd = random.Random(5)
    for _ in range(20_000):
        text = "".join(rnd.choice('ab"\t\n\r') for _ in range(rnd.randint(1, 9)))
        try:
            got = R.split_record(text)
        except R.Rejected:
            got = None
        assert got == brute(text), repr(text)


def test_assemble():
    texts = lambda lines, **k: [t for _, t in R.assemble(lines, **k)]
    assert list(R.assemble(["a\tb", '"c', 'd"\te', "f"])) == [(0, "a\tb"), (1, '"c\nd"\te'), (3, "f")]
    assert texts(['x"y', "z"]) == ['x"y', "z"]
    assert texts(['"a""', 'b"', "c"]) == ['"a""\nb"', "c"]
    # A quote that never closes, closes too late or closes to something broken costs its own line only.
    assert texts(['"never', "closed"]) == ['"never', "closed"]
    assert texts(['"a', "b", 'c"'], max_lines=2) == ['"a', "b", 'c"']
    assert texts(['"a', 'b"c\td', '"e', 'f"']) == ['"a', 'b"c\td', '"e\nf"']


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("@a\nACGT\n+\nIIII", None),
        ("@a\r\nACGT\r\n+a\r\nIIII\r\n", None),
        ("@a\nACGT\n+\nIIII\n", None),
        ("@a\nACGT\n+\nIIII\n\n", "line_count"),
        ("@a\nACGT\n+\nIIII\r", "quality"),
        ("@\nACGT\n+\nIIII", "description"),
        ("@ a\nACGT\n+\nIIII", "description"),
        ("a\nACGT\n+\nIIII", "description"),
        ("@a\n\n+\n", "line_count"),
        ("@a\n\n+\n\n", "sequence"),
        ("@a\nACGU\n+\nIIII", "sequence"),
        ("@a\nACGT\n+b\nIIII", "separator"),
        ("@a\nACGT\n+\nIII", "quality_length"),
        ("@a\nACGT\n+\nII I", "quality"),
        ('@a\nACGT\n+\n"I""', None),
        ("", "line_count"),
    ],
)
def test_fastq(text, reason):
    try:
        R.fastq_record(text)
        got = None
    except R.Rejected as e:
        got = str(e)
    assert got == reason


def test_operators_on_odd_tables(spark):
    contigs = spark.createDataFrame([(0, "chr1", 1000), (1, None, 5)], "contig_id int, contig_name string, contig_length bigint")
    line = "\t".join(GOOD)
    raw = spark.createDataFrame([(1, line, "x"), (1, line, "x"), (2, None, "y"), (None, "#h", "z"), (3, "", "q"), (4, "bad", None)], "raw_id bigint, line_text string, reason string")
    rows = R.parse_vcf(raw, contigs).collect()
    assert sorted((r.raw_id, r.reason or "") for r in rows) == [(1, ""), (1, ""), (2, "null_text"), (4, "field_count")]
    assert {r.contig_name for r in rows if r.reason is None} == {"chr1"}
    assert R.parse_vcf(raw.limit(0), contigs).count() == 0
    fq = spark.createDataFrame([(1, None), (2, "@a/1 x\nA\n+\nI")], "raw_id bigint, record_text string")
    assert sorted((r.raw_id, r.reason, r.read_name) for r in R.parse_fastq(fq).collect()) == [(1, "null_text", None), (2, None, "a")]
