"""FASTQ and FASTA files as Python data sources: ``spark.read.format("strand_fastq").load(path)`` after ``register(spark)``.

Plain FASTQ files are split by byte ranges; a reader moves to the first true record at or after its range's start (an ``@`` line whose second next
line begins with ``+``), and reads on to the first that begins after its end. Compressed files can't be split and are one partition each. FASTA
files are read one per partition and come out in slices, as reference.py uses them. Paths are of a file system that all executors see.
"""

from __future__ import annotations

import glob
import gzip
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20


def _files(path: str) -> list[str]:
    bare = path.removeprefix("file://")
    found = sorted(glob.glob(bare)) if not os.path.isdir(bare) else sorted(os.path.join(bare, x) for x in os.listdir(bare) if not x.startswith(("_", ".")))
    if not found:
        raise FileNotFoundError(path)
    return found


def _open(path: str):
    return gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


def records(path: str, start: int = 0, end: int | None = None):
    """(description, read name, sequence, qualities) of the records that begin in [start, end)."""
    with _open(path) as f:
        at = start
        if start:
            f.seek(start - 1)
            at = start - 1 + len(f.readline())  # to the next line's begin
        window: list[tuple[int, bytes]] = []

        def line():
            nonlocal at
            text = f.readline()
            if not text:
                return None
            begun, at = at, at + len(text)
            return begun, text.rstrip(b"\r\n")

        while len(window) < 4 and (x := line()) is not None:
            window.append(x)
        if start and len(window) < 4:
            return  # the rest of a record that began before
        # A quality line may begin with @ too, so the line after next has to begin with +, and not the next but one after that.
        while len(window) == 4 and start and not (window[0][1][:1] == b"@" and window[2][1][:1] == b"+" and len(window[1][1]) == len(window[3][1])):
            window.pop(0)
            if (x := line()) is None:
                return
            window.append(x)
        while len(window) == 4 and (end is None or window[0][0] < end):
            head, seq, plus, quals = (x[1].decode("utf-8", "replace") for x in window)
            if head[:1] != "@" or plus[:1] != "+" or len(seq) != len(quals):
                raise ValueError(f"{path}: no FASTQ record at byte {window[0][0]}")
            name = head[1:].split(" ", 1)[0]
            yield head[1:], name[:-2] if name[-2:] in ("/1", "/2") else name, seq, quals
            window = []
            while len(window) < 4 and (x := line()) is not None:
                window.append(x)
        if 0 < len(window) < 4 and any(x[1] for x in window) and (end is None or window[0][0] < end):
            raise ValueError(f"{path}: the last record is cut off")


class FastqReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self):
        out = []
        for path in _files(self.path):
            size = os.path.getsize(path)
            if path.endswith(".gz"):
                out.append(Span(path, 0, None))
            else:
                out += [Span(path, s, min(size, s + self.split)) for s in range(0, max(size, 1), self.split)]
        return out

    def read(self, partition):
        yield from records(partition.path, partition.start, partition.end)


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "strand_fastq"

    def schema(self):
        return "description string, read_name string, seq string, base_quals string"

    def reader(self, schema):
        return FastqReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def fasta_slices(path: str, size: int):
    """(contig, slice, sequence) of a FASTA file; a contig's name ends at the first blank."""
    with _open(path) as f:
        contig, held, held_size, index = None, [], 0, 0
        for raw in f:
            text = raw.decode("ascii", "replace").strip()
            if text.startswith(">"):
                if contig is not None and held_size:
                    yield contig, index, "".join(held)
                contig, held, held_size, index = text[1:].split(None, 1)[0] if len(text) > 1 else "", [], 0, 0
                continue
            if contig is None:
                if text:
                    raise ValueError(f"{path}: sequence before the first name")
                continue
            held.append(text)
            held_size += len(text)
            while held_size >= size:
                whole = "".join(held)
                yield contig, index, whole[:size]
                held, held_size, index = [whole[size:]], held_size - size, index + 1
        if contig is not None and held_size:
            yield contig, index, "".join(held)


class FastaReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self):
        return [Span(p, 0, None) for p in _files(self.path)]

    def read(self, partition):
        for contig, index, seq in fasta_slices(partition.path, self.size):
            yield contig, index, "".join(x if x in "ACGT" else "N" for x in seq.upper()).ljust(self.size, "N")


class FastaSource(DataSource):
    @classmethod
    def name(cls):
        return "strand_fasta"

    def schema(self):
        return "contig string, slice bigint, seq string"

    def reader(self, schema):
        return FastaReader(self.options["path"], int(self.options.get("slice", 4096)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)
    spark.dataSource.register(FastaSource)
