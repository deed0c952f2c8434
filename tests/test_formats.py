import gzip
import random

import pytest
from conftest import SMALL

from strandlake.kernels import codec
from strandlake.plans.stages import Plan, PlanError, Stage
from strandlake.sources import fastq, text
from strandlake.streaming import streams
from strandlake.tables import table


def fq(i, rnd):
    n = rnd.randint(1, 60)
    return f"@r{i}/1 x\n{''.join(rnd.choice('ACGTN') for _ in range(n))}\n+\n{'@' if i % 3 else '+'}{''.join(rnd.choice('@+!I~') for _ in range(n - 1))}\n"


def test_fastq_splits(spark, tmp_path):
    rnd = random.Random(3)
    body = "".join(fq(i, rnd) for i in range(400))
    path = tmp_path / "a.fastq"
    path.write_text(body)
    whole = list(fastq.records(str(path)))
    assert len(whole) == 400 and whole[7][1] == "r7"
    size = len(body)
    for split in (61, 97, 500, 5000):
        parts = [r for s in range(0, size, split) for r in fastq.records(str(path), s, min(size, s + split))]
        assert parts == whole
    fastq.register(spark)
    assert spark.read.format("strand_fastq").option("split_bytes", 999).load(str(path)).count() == 400
    zipped = tmp_path / "b.fastq.gz"
    zipped.write_bytes(gzip.compress(body.encode()))
    assert list(fastq.records(str(zipped))) == whole
    (tmp_path / "bad.fastq").write_text("@a\nAC\n+\nI\n")
    with pytest.raises(ValueError, match="no FASTQ record"):
        list(fastq.records(str(tmp_path / "bad.fastq")))


def test_fasta(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_text(">1 first\nACGTA\nCGr\n\n>chr2\nTT\n>3\n")
    fastq.register(spark)
    rows = spark.read.format("strand_fasta").option("slice", 4).load(str(path)).collect()
    assert sorted(map(tuple, rows)) == [("1", 0, "ACGT"), ("1", 1, "ACGN"), ("chr2", 0, "TTNN")]


def test_records_over_lines_wherever_files_are_split(spark, tmp_path):
    """Quoted line ends, lost quotes and carriage returns: the same records as assembling the whole file, for any split size."""
    from strandlake.operators import rejects

    rnd = random.Random(21)
    for kind in ("some", "many", "none"):
        lines = []
        for i in range(300):
            r = rnd.random() if kind != "none" else 1
            if r < (0.05 if kind == "some" else 0.3):
                lines += [f'1\t{i}\t"a', *(rnd.choice(["", "mid", '"', "x\ty"]) for _ in range(rnd.randint(0, 4))), 'end"\tA\tC']
            elif r < 0.4:
                lines.append(rnd.choice(['1\t"lost', '"x"y\tz', 'a"b\tc']))
            else:
                lines.append(f"1\t{i}\t.\tA\tC" + ("\r" if i % 5 == 0 else ""))
        path = tmp_path / f"{kind}.vcf"
        path.write_text("\n".join(lines) + "\n", newline="")
        expected = [(n + 1, t.removesuffix("\r")) for n, t in rejects.assemble(lines, max_lines=5)]
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        try:
            for size in ("97b", "1000b", "1m"):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                got = sorted((r.file_line, r.line_text) for r in text.text_records(spark, str(path), max_lines=5, chunk=7).collect())
                assert got == expected, (kind, size)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fastq_records_wherever_files_are_split(spark, tmp_path):
    rnd = random.Random(9)
    for n, name in ((0, "none"), (23, "many"), (6, "cut")):
        body = "".join(f"@r{i}\n{'ACGT' * rnd.randint(1, 9)}\n+\n{'I' * rnd.randint(4, 36)}\n" for i in range(n)) + ("@last\nAC\n" if name == "cut" else "")
        path = tmp_path / f"{name}.fastq"
        path.write_text(body)
        lines = body.splitlines()
        expected = [(i // 4 + 1, "\n".join(lines[i : i + 4])) for i in range(0, len(lines), 4)]
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        try:
            for size in ("41b", "400b", "1m"):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                assert sorted((r.file_record, r.record_text) for r in text.fastq_records(spark, str(path)).collect()) == expected, (name, size)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_headers_end_with_their_first_other_line(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.vcf").write_text("##a\n##b\n#CHROM\n##late\n")
    (tmp_path / "h" / "b.vcf.gz").write_bytes(gzip.compress("".join(f"##c{i}\n" for i in range(150_000)).encode()))
    assert text.vcf_header(spark, str(tmp_path / "h" / "a.vcf")) == ["##a", "##b"]
    assert len(text.vcf_header(spark, str(tmp_path / "h"))) == 150_002
    with pytest.raises(ValueError, match="more than 10"):
        text._leading(spark, str(tmp_path / "h"), "##", most=10)
    (tmp_path / "p.list").write_text("@SQ\n1\t5\t9\t+\ta\n1\tx\t9\n1\t9\t5\nq\n\t1\t2\n")
    assert sorted((r.file_line, r.reason) for r in text.interval_lines(spark, str(tmp_path / "p.list")).collect()) == [(2, None), (3, "position"), (4, "order"), (5, "field_count"), (6, "contig")]


def test_text_readers(spark, tmp_path):
    (tmp_path / "d.dict").write_text("@HD\tVN:1\n@SQ\tSN:1\tLN:100\tM5:x\tUR:file:/a.fa\n@SQ\tSN:MT\tLN:10\n")
    contigs = text.read_dictionary(spark, str(tmp_path / "d.dict"))
    assert [tuple(r) for r in contigs.collect()] == [(0, "1", 100, "x", "file:/a.fa"), (1, "MT", 10, None, None)]
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nr\t16\tchrM\t5\t60\t3M\t=\t9\t4\tACG\tIII\tNM:i:0\tRG:Z:g1\nq\t4\t*\t0\tx\t*\t*\t0\t0\t*\t*\n")
    rows = {r.read_name: r for r in text.read_sam(spark, str(tmp_path / "a.sam"), contigs).collect()}
    assert rows["r"].contig_id == 1 and rows["r"].mate_contig_name == "chrM" and rows["r"].attributes == ["NM:i:0", "RG:Z:g1"] and rows["r"].read_group == "g1"
    assert rows["q"].contig_id == 255 and rows["q"].map_q is None
    assert text.read_sam(spark, str(tmp_path / "a.sam"), contigs, drop_unknown=True).count() == 1
    (tmp_path / "p.list").write_text("@SQ\n1\t5\t9\t+\ta\n1\tx\t9\n1\t9\t5\n")
    assert [tuple(r) for r in text.read_intervals(spark, str(tmp_path / "p.list")).collect()] == [("1", 5, 9)]
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\n1\t5\t.\tA\tC\t.\tPASS\tDP=1\n1\t500\t.\tA\tC\t.\tPASS\tDP=1\n")
    good, bad = text.read_vcf(spark, str(tmp_path / "a.vcf"), contigs)
    assert good.count() == 1 and [r.reason for r in bad.collect()] == ["position"]
    assert text.vcf_header(spark, str(tmp_path / "a.vcf")) == ["##x"]


def test_codec():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(0, 400)
        seq = "".join(rnd.choice("ACGTN") for _ in range(n))
        assert codec.unpack_bases(codec.pack_bases(seq)) == seq
        quals = "".join(chr(33 + min(93, max(0, int(rnd.gauss(35, 6))))) for _ in range(n))
        assert codec.unpack_qualities(codec.pack_qualities(quals)) == quals
    assert len(codec.pack_bases("ACGT" * 1000)) < 1100


def stage(name, inputs, outputs, **kw):
    return Stage(name, tuple(inputs), tuple(outputs), lambda *a: a[0], **kw)


def test_plan_order():
    plan = Plan().add(stage("c", ["y"], ["z"])).add(stage("b", ["x", "w"], ["y"])).add(stage("a", ["in"], ["x"])).add(stage("d", ["in"], ["w"]))
    order = plan.order({"in"})
    assert order.index("a") < order.index("b") < order.index("c") and order.index("d") < order.index("b")
    assert plan.chains() == [["b", "c"]]
    with pytest.raises(PlanError, match="nothing makes"):
        plan.order()
    with pytest.raises(PlanError, match="again"):
        plan.add(stage("e", ["in"], ["z"]))
    with pytest.raises(PlanError, match="cycle"):
        Plan().add(stage("p", ["b"], ["a"])).add(stage("q", ["a"], ["b"])).order()
    fused = Plan().add(stage("a", ["in"], ["x"])).add(stage("b", ["x"], ["y"])).add(stage("c", ["y"], ["z"], fusible=False))
    assert fused.chains() == [["a", "b"]]


def test_plan_runs(spark):
    plan = Plan(spark, {"in": spark.range(3)}).add(Stage("double", ("in",), ("twice",), lambda d: d.selectExpr("id * 2 AS id"))).add(Stage("two", ("twice",), ("lo", "hi"), lambda d: (d.where("id < 2"), d.where("id >= 2"))))
    tables = plan.run(views=True)
    assert tables["hi"].count() == 2 and spark.sql("SELECT count(*) AS n FROM twice").head().n == 3
    with pytest.raises(PlanError, match="no table"):
        tables["nowhere"]
    wrong = Plan(spark, {"in": spark.range(1)}).add(Stage("w", ("in",), ("a", "b"), lambda d: d))
    with pytest.raises(PlanError, match="made 1"):
        wrong.run()


def test_streams(spark, tmp_path):
    raw = table(spark, SMALL, "raw_vcf")
    contigs = table(spark, SMALL, "contigs")
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.parsed_stream(streams.folder_stream(spark, str(tmp_path / "in"), raw.schema, 1), contigs)
    query = streams.split_to_tables(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    from strandlake.operators import rejects

    batch = rejects.parse_vcf(raw, contigs)
    assert spark.read.parquet(str(tmp_path / "good")).count() == rejects.valid(batch).count()
    assert spark.read.parquet(str(tmp_path / "bad")).count() == rejects.rejected(batch).count()

    events = table(spark, SMALL, "events").orderBy("ts")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    live = streams.folder_stream(spark, str(tmp_path / "ev"), events.schema)
    counts = streams.windowed_counts(live, "ts", ["event_type"])
    q = counts.writeStream.format("memory").queryName("live_counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    expected = {tuple(r) for r in streams.windowed_counts(events, "ts", ["event_type"]).collect()}
    got = {tuple(r) for r in spark.table("live_counts").collect()}
    assert got <= expected and len(got) > 0.9 * len(expected)  # the last windows stay open
