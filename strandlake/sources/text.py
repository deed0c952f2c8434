"""Text formats as DataFrames: aligned reads, variants, intervals, sequence dictionaries."""

from __future__ import annotations

from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators import intervals, rejects
from strandlake.session import staged
from strandlake.tables import NO_CONTIG, with_contig

_SAM = [("read_name", "string"), ("flag", "int"), ("contig_name", "string"), ("contig_position", "int"), ("map_q", "int"), ("cigar", "string"), ("mate_contig_name", "string"), ("mate_position", "int"), ("inferred_size", "int"), ("seq", "string"), ("base_quals", "string")]


def sam_columns(line: Column) -> list[Column]:
    """The eleven fixed columns of a SAM line, typed (null where malformed), and its tags."""
    parts = F.split(line, "\t")
    fixed = [(F.get(parts, F.lit(i)).try_cast(kind) if kind == "int" else F.get(parts, F.lit(i))).alias(name) for i, (name, kind) in enumerate(_SAM)]
    tags = F.when(F.size(parts) > 11, F.slice(parts, 12, F.greatest(F.size(parts) - 11, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return [*fixed, tags.alias("attributes")]


def read_sam(spark: SparkSession, path: str, contigs: DataFrame, drop_unknown: bool = False) -> DataFrame:
    """Aligned reads of SAM text files (a glob works), header lines skipped. ``=`` becomes the own contig, ``*`` contig id 255.

    drop_unknown: leave out reads whose contig the dictionary doesn't have.
    """
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select(*sam_columns(F.col("value")))
    named = with_contig(rows, contigs, "contig_name", out="_c", code="_code")
    named = named.where("_code is not null") if drop_unknown else named
    mate = F.when(F.col("mate_contig_name") == "=", F.col("contig_name")).otherwise(F.col("mate_contig_name"))
    group = F.regexp_extract(F.get(F.filter("attributes", lambda t: t.startswith("RG:Z:")), F.lit(0)), "^RG:Z:(.*)$", 1)
    return named.withColumns({"contig_id": F.coalesce("_code", F.lit(NO_CONTIG)), "mate_contig_name": mate, "read_group": group}).drop("_c", "_code")


def sam_header(spark: SparkSession, path: str) -> list[str]:
    """Header lines of the files of a glob, in the order of files and lines; see ``_leading``."""
    return _leading(spark, path, "@")


def vcf_header(spark: SparkSession, path: str) -> list[str]:
    return _leading(spark, path, "##")


def _leading(spark: SparkSession, path: str, prefix: str, most: int = 1_000_000, step: int = 1 << 16) -> list[str]:
    """The lines that begin with ``prefix`` at the head of each file. Read through Hadoop's file systems from a file's begin to its first other line; no job runs.

    A header has a few lines per contig; more than ``most`` are an error.
    """
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f for f in fs.globStatus(place) or []]
    files = sorted(str(x.getPath()) for f in found for x in (fs.listStatus(f.getPath()) if f.isDirectory() else [f]) if not x.getPath().getName().startswith(("_", ".")))
    if not files:
        raise FileNotFoundError(path)
    lines: list[str] = []
    for name in files:
        file = jvm.org.apache.hadoop.fs.Path(name)
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(file)
        stream = fs.open(file)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec is not None else stream, "UTF-8"), step)
        try:
            while (line := reader.readLine()) is not None and line.startswith(prefix):
                lines.append(line)
                if len(lines) > most:
                    raise ValueError(f"{path} has more than {most} header lines")
        finally:
            reader.close()
    return lines


_LINES = "file_name string, block bigint, at bigint, line_text string, opens boolean"
#: Lines of a chunk whose open fields are closed in one task.
CHUNK_LINES = 8192


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, file_line, line_text, opens) of text files: the number of each physical line in its file from 1, the same in every evaluation, and if it ends inside a quoted field.

    Lines are counted within the splits in which Spark reads a file; a split's first number comes from the counts of the splits before it.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("block"), "value")

    def numbered(batches):
        of, at = None, 0
        for batch in batches:
            places, opens = [], []
            for file, block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (file, block) != of:
                    of, at = (file, block), 0
                places.append(at)
                at += 1
                opens.append('"' in text and rejects.ends_open(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.int64()), batch.column(2), pa.array(opens, pa.bool_())], names=["file_name", "block", "at", "line_text", "opens"])

    blocks = raw.groupBy("file_name", "block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("file_name").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row per split
    firsts = blocks.select("file_name", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return raw.mapInArrow(numbered, _LINES).join(firsts, ["file_name", "block"]).select("file_name", (F.col("_before") + F.col("at") + 1).alias("file_line"), "line_text", "opens")


def text_records(spark: SparkSession, path: str, max_lines: int = rejects.MAX_LINES, chunk: int = CHUNK_LINES) -> DataFrame:
    """(file_name, file_line, line_text) of the records of text files, assembled quote-aware as ``rejects.assemble`` does, wherever Spark splits a file.

    Where a line ends inside a quoted field, the lines of its chunk and the ``max_lines`` after it tell where the field closes. Such stretches that overlap
    are taken from the first on; lines they cover are no records of their own. Carriage returns at the end of a record are dropped.
    """
    lines = numbered_lines(spark, path)
    plain = lines.select("file_name", "file_line", F.regexp_replace("line_text", "\r$", "").alias("line_text"))
    if lines.where("opens").limit(1).count() == 0:
        return plain
    index = F.expr(f"(file_line - 1) div {chunk}")
    needed = lines.where("opens").select("file_name", index.alias("chunk")).distinct()
    # A chunk sees its own lines and the next ``max_lines``, which belong to one or more chunks after it.
    back = -(-max_lines // chunk)
    spread = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(back))).alias("_back")).withColumn("chunk", index - F.col("_back"))
    spread = spread.where((F.col("chunk") >= 0) & (F.col("file_line") <= (F.col("chunk") + 1) * chunk + max_lines)).join(needed, ["file_name", "chunk"], "left_semi")

    def closed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.sort_by("file_line")
        texts, numbers, opens = rows.column("line_text").to_pylist(), rows.column("file_line").to_pylist(), rows.column("opens").to_pylist()
        last_own = (key[1].as_py() + 1) * chunk
        found = []
        for i, (number, is_open) in enumerate(zip(numbers, opens, strict=True)):
            if is_open and number <= last_own:
                n = rejects.closing(texts[i : i + max_lines], max_lines)
                if n > 1:
                    found.append((key[0].as_py(), number, number + n - 1, "\n".join(texts[i : i + n])))
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        return pa.table({"file_name": pa.array(columns[0], pa.string()), "first": pa.array(columns[1], pa.int64()), "last": pa.array(columns[2], pa.int64()), "line_text": pa.array(columns[3], pa.string())})

    stretches = staged(spread.select("file_name", "chunk", "file_line", "line_text", "opens").groupBy("file_name", "chunk").applyInArrow(closed, "file_name string, first bigint, last bigint, line_text string"), "quoted-stretches")
    islands = intervals.merged(stretches, ["file_name"], "first", "last", abutting=False).select(F.col("file_name").alias("_file"), "from_position", "to_position")
    grouped = stretches.join(islands, (F.col("file_name") == F.col("_file")) & F.col("first").between(F.col("from_position"), F.col("to_position")))

    def from_the_first(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, end = [], 0
        for row in pdf.sort_values("first").itertuples():
            if row.first > end:
                taken.append((row.file_name, row.first, row.last, row.line_text))
                end = row.last
        return pd.DataFrame(taken, columns=["file_name", "first", "last", "line_text"])

    kept = staged(grouped.groupBy("_file", "from_position").applyInPandas(from_the_first, "file_name string, first bigint, last bigint, line_text string"), "quoted-records")
    covered = kept.select("file_name", F.explode(F.sequence("first", "last")).alias("file_line"))
    return plain.join(covered, ["file_name", "file_line"], "left_anti").unionByName(kept.select("file_name", F.col("first").alias("file_line"), F.regexp_replace("line_text", "\r$", "").alias("line_text")))


def read_vcf(spark: SparkSession, path: str, contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variants, rejected records) of VCF text files, both with file_name and file_line; records may hold line ends in quotes. The rejected ones have the reason and their text."""
    raw = text_records(spark, path)
    parsed = rejects.parse_vcf(raw, contigs, "file_line", "line_text", kept=["file_name", "file_line", "line_text"]).drop("raw_id")
    return rejects.valid(parsed).drop("line_text"), parsed.where("reason is not null").select("file_name", "file_line", "reason", "line_text")


_EDGES = "file_name string, block bigint, at bigint, n bigint, line string"
_FASTQ_TEXT = "file_name string, file_record bigint, record_text string"


def fastq_records(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, file_record, record_text) of FASTQ text files in any file system that Spark reads, split as it splits them: four lines each, the last record of a file as it is.

    A first pass counts the lines of each split and keeps its first and last three; from the counts each split knows which of its lines begin records.
    The second pass joins the lines inside splits; records that lie across are put together from the kept lines. Nothing else is shuffled. What the driver holds
    is a number per split.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("block"), "value")

    def lines_of(batches):
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)

    def edges(batches):
        of, head, tail, n = None, [], deque(maxlen=3), 0

        def rows():
            ends = {i: t for i, t in enumerate(head)} | {n - len(tail) + i: t for i, t in enumerate(tail)}
            return [(*of, at, n, line) for at, line in sorted(ends.items())]

        def batch_of(found):
            columns = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file_name", "block", "at", "n", "line"])

        for file, block, line in lines_of(batches):
            if (file, block) != of:
                if of is not None:
                    yield batch_of(rows())
                of, head, tail, n = (file, block), [], deque(maxlen=3), 0
            if n < 3:
                head.append(line)
            tail.append(line)
            n += 1
        if of is not None:
            yield batch_of(rows())

    kept = staged(raw.mapInArrow(edges, _EDGES), "fastq-edges")
    before: dict[tuple[str, int], int] = {}
    totals: dict[str, int] = {}
    for file, block, n in sorted(kept.select("file_name", "block", "n").distinct().collect()):
        before[file, block] = totals.get(file, 0)
        totals[file] = before[file, block] + n
    held = spark.sparkContext.broadcast(before)

    def inside(batches):
        of, number, lines, out = None, 0, [], []
        for batch in batches:
            for file, block, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (file, block) != of:
                    of, number, lines = (file, block), held.value[file, block], []
                if lines or number % 4 == 0:
                    lines.append(line)
                    if len(lines) == 4:
                        out.append((file, number // 4 + 1, "\n".join(lines)))
                        lines = []
                number += 1
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["file_name", "file_record", "record_text"])
            out = []

    starts = spark.createDataFrame([(f, b, n, totals[f]) for (f, b), n in before.items()], "_f string, _b bigint, _before bigint, _total bigint")
    placed = kept.join(starts, (F.col("file_name") == F.col("_f")) & (F.col("block") == F.col("_b"))).withColumn("_line", F.col("_before") + F.col("at"))
    record = F.expr("_line div 4")
    # A record is inside one split if that split has its first line and its last one, or the file ends before.
    first, last = record * 4, record * 4 + 3
    whole = (first >= F.col("_before")) & (last < F.col("_before") + F.col("n"))
    across = placed.where(~whole).groupBy("file_name", (record + 1).alias("file_record")).agg(F.array_sort(F.collect_list(F.struct("_line", "line"))).alias("_l"))
    return raw.mapInArrow(inside, _FASTQ_TEXT).unionByName(across.select("file_name", "file_record", F.array_join("_l.line", "\n").alias("record_text")))


def read_fastq(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reads, rejected records) of FASTQ text files, both with file_name and file_record; the rejected ones have the reason and their text."""
    parsed = rejects.parse_fastq(fastq_records(spark, path), "file_record", "record_text", kept=["file_name", "file_record", "record_text"]).drop("raw_id")
    return rejects.valid(parsed).drop("record_text"), parsed.where("reason is not null").select("file_name", "file_record", "reason", "record_text")


def interval_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, file_line, contig_name, start_position, stop_position, reason) of tab separated intervals; lines that start with ``@`` are headers.

    Each other line comes out, with nulls and a reason where it is malformed: ``field_count`` under three fields, ``contig`` without a name, ``position`` for a bound that is no number, ``order`` where the end lies before the start.
    """
    parts = F.split(F.regexp_replace("line_text", "\r$", ""), "\t")
    got = numbered_lines(spark, path).where(~F.col("line_text").startswith("@") & (F.trim("line_text") != "")).select(
        "file_name", "file_line", F.size(parts).alias("_n"), F.get(parts, F.lit(0)).alias("contig_name"), F.get(parts, F.lit(1)).try_cast("bigint").alias("start_position"), F.get(parts, F.lit(2)).try_cast("bigint").alias("stop_position")
    )
    reason = F.when(F.col("_n") < 3, "field_count").when(F.trim("contig_name") == "", "contig").when(F.col("start_position").isNull() | F.col("stop_position").isNull(), "position").when(F.col("start_position") > F.col("stop_position"), "order")
    return got.withColumn("reason", reason).drop("_n")


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(contig_name, start_position, stop_position) of the sound lines of ``interval_lines``."""
    return interval_lines(spark, path).where("reason is null").select("contig_name", "start_position", "stop_position")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Contigs of the ``@SQ`` lines of a dictionary, numbered from 0 in their order. A dictionary is one small file, read as a whole."""
    text = spark.read.text(path, wholetext=True).head()[0]
    rows = []
    for line in text.splitlines():
        if line.startswith("@SQ"):
            tags = dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x)
            rows.append((len(rows), tags.get("SN"), int(tags["LN"]) if "LN" in tags else None, tags.get("M5"), tags.get("UR")))
    return spark.createDataFrame(rows, "contig_id int, contig_name string, contig_length bigint, md5_tag string, uri string")


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates of two FASTQ tables side by side, by read name; the order of mates is that of the arguments."""
    b = second.select("read_name", F.col("seq").alias("seq2"), F.col("base_quals").alias("quals2"))
    return first.select("read_name", F.col("seq").alias("seq1"), F.col("base_quals").alias("quals1")).join(b, "read_name")
