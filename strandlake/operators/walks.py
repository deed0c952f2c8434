"""Results per position and per base from one exchange of reads.

Reads go to the bins of positions that they overlap, and a task walks over its bins one after the other. Whole bins are looked at in two passes: the
first counts what the second compares each base with, such as the consensus. What is shuffled is reads, never bases, and nothing is joined by position.
Small bins are taken together as one block of arrays; a deep one is decoded block by block in either pass, with its reads in a local file
beyond ``HELD_READS``, so memory is that of a block and of the counts per position.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import cigar as C
from strandlake.kernels import columns as K
from strandlake.operators.tallies import WIDTH, _summed
from strandlake.tables import FLAG_REVERSE

#: Reads decoded at once, and reads of whole bins that are held in memory.
BLOCK, HELD_READS = 1 << 12, 1 << 16
LETTERS = "ACGT"
_CONTIG_SHIFT = 40
_BASE = np.full(256, len(LETTERS), np.int8)
for _i, _b in enumerate(LETTERS):
    _BASE[ord(_b)] = _BASE[ord(_b.lower())] = _i


def codes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``K.letters`` with the code point of each character."""
    texts = [t or "" for t in texts]
    joined = "".join(texts)
    if joined.isascii():
        return K.letters(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.cumsum(sizes) - sizes, sizes


@dataclass
class Block:
    """Reads and their elements inside of their bin: index of the read, contig and position as one ``key``, and where in the read it is. ``first_key`` is that of each read's start."""

    rows: pa.RecordBatch
    read: np.ndarray
    key: np.ndarray
    offset: np.ndarray
    deletion: np.ndarray
    next_op: np.ndarray
    prev_op: np.ndarray
    first_key: np.ndarray

    def of_read(self, column: str, null: int) -> np.ndarray:
        return self.rows.column(column).fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)

    @cached_property
    def base(self) -> np.ndarray:
        """0 to 3 for the ``LETTERS``, else 4."""
        return np.where(self.letter < 256, _BASE[np.minimum(self.letter, 255)], len(LETTERS)).astype(np.int64)

    @cached_property
    def letter(self) -> np.ndarray:
        """Code points in upper case; 0 for a deletion."""
        letter = K.picked(codes_of(self.rows.column("seq").to_pylist()), self.read, self.offset).astype(np.int64)
        return np.where(self.deletion, 0, K.upper(letter))

    @cached_property
    def has_qual(self) -> np.ndarray:
        return np.array([q not in (None, "", "*") for q in self.rows.column("base_quals").to_pylist()], bool)[self.read] & ~self.deletion

    @cached_property
    def qual(self) -> np.ndarray:
        return K.picked(codes_of(self.rows.column("base_quals").to_pylist()), self.read, self.offset).astype(np.int64) - 33

    @cached_property
    def strand(self) -> np.ndarray:
        """0 forward, 1 reverse, 2 unknown; per read."""
        return self.of_read("is_reverse", 2)

    @cached_property
    def map_q(self) -> np.ndarray:
        """-1 where there is none; per read."""
        return self.of_read("map_q", -1)

    @cached_property
    def gap(self) -> np.ndarray:
        """Whether an indel follows right after."""
        return ~self.deletion & ((self.next_op == K.INSERTION) | (self.next_op == K.DELETION))


class Bins:
    """Reads of whole bins, to be walked over as often as needed."""

    def __init__(self, width: int):
        self.width, self.names, self.n = width, {}, 0
        self._held: list[pa.RecordBatch] = []
        self._file = self._writer = None
        self._decoded: list[Block] | None = None

    def add(self, rows: pa.RecordBatch) -> None:
        self.n += rows.num_rows
        self._held.append(rows)
        if self.n > HELD_READS:
            if self._file is None:
                self._file = tempfile.TemporaryFile()  # noqa: SIM115 - closed with the bins
                self._writer = pa.ipc.new_stream(self._file, rows.schema)
            for x in self._held:
                self._writer.write_batch(x)
            self._held = []

    def _batches(self) -> Iterator[pa.RecordBatch]:
        if self._file is not None:
            if self._writer is not None:
                self._writer.close()
                self._writer = None
            self._file.seek(0)
            stored = pa.ipc.open_stream(self._file)
            yield from self._joined(stored)
        yield from self._joined(self._held)

    @staticmethod
    def _joined(batches) -> Iterator[pa.RecordBatch]:
        """The same rows in batches of about ``BLOCK``."""
        waiting, n = [], 0

        def whole():
            return pa.Table.from_batches(waiting).combine_chunks().to_batches()

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                waiting.append(piece)
                n += piece.num_rows
                if n >= BLOCK:
                    yield from whole()
                    waiting, n = [], 0
        if waiting:
            yield from whole()

    def blocks(self) -> Iterator[Block]:
        if self._decoded is not None:
            yield from self._decoded
        elif self.n <= 2 * BLOCK:
            self._decoded = [self._block(x) for x in self._batches()]
            yield from self._decoded
        else:
            for x in self._batches():
                yield self._block(x)

    def _block(self, rows: pa.RecordBatch) -> Block:
        coded = rows.column("contig").dictionary_encode()
        codes = np.array([self.names.setdefault(name, len(self.names)) for name in coded.dictionary.to_pylist()], np.int64)
        contig = codes[coded.indices.to_numpy(zero_copy_only=False)]
        starts = rows.column("contig_position").to_numpy(zero_copy_only=False).astype(np.int64)
        first = rows.column("bin").to_numpy(zero_copy_only=False).astype(np.int64) * self.width + 1
        els = K.elements(rows.column("cigar").to_pylist(), starts)
        inside = (els.position >= first[els.read]) & (els.position < first[els.read] + self.width)
        read = els.read[inside]
        return Block(rows, read, (contig[read] << _CONTIG_SHIFT) + els.position[inside], els.offset[inside], els.deletion[inside], els.next_op[inside], els.prev_op[inside], (contig << _CONTIG_SHIFT) + starts)

    def locus(self, keys: np.ndarray) -> list[pa.Array]:
        """Contig and position of keys."""
        contig = pa.DictionaryArray.from_arrays(pa.array(keys >> _CONTIG_SHIFT, pa.int32()), pa.array(list(self.names), pa.string())).cast(pa.string())
        return [contig, pa.array(keys & ((1 << _CONTIG_SHIFT) - 1), pa.int64())]

    def close(self) -> None:
        if self._file is not None:
            self._file.close()


def _whole_bins(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Bins]:
    """Sorted rows as whole bins, several of them together up to about a block."""
    bins, last = Bins(width), None
    for batch in batches:
        if not batch.num_rows:
            continue
        number, contig = batch.column("bin").to_numpy(zero_copy_only=False), batch.column("contig").dictionary_encode()
        code = contig.indices.to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero((number[1:] != number[:-1]) | (code[1:] != code[:-1])) + 1, batch.num_rows]
        taken = 0  # rows before this one are in bins already
        for a in map(int, cuts[:-1]):
            here = (contig.dictionary[int(code[a])].as_py(), int(number[a]))
            if here != last and bins.n + a - taken >= BLOCK:
                if a > taken:
                    bins.add(batch.slice(taken, a - taken))
                    taken = a
                yield bins
                bins.close()
                bins = Bins(width)
            last = here
        bins.add(batch.slice(taken))
    if bins.n:
        yield bins
        bins.close()


def walked(rows: DataFrame, carried: dict[str, Column], function: Callable[[Bins], Iterator[pa.RecordBatch]], schema: str, width: int = WIDTH) -> DataFrame:
    """What a function makes of whole bins of placed reads (``pileup.read_rows``): contig, contig_position, cigar, seq, base_quals, map_q, is_reverse and the ``carried`` columns."""
    rows = rows.where(F.col("seq").isNotNull() & ~F.col("seq").isin("", "*"))
    start = F.col("contig_position").cast("bigint")
    last = start + F.greatest(C.reference_length(F.col("cigar")), F.lit(1)) - 1
    bins = F.sequence(F.expr(f"(contig_position - 1) div {width}"), F.floor((last - 1) / width).cast("bigint"))
    reverse = (F.col("flag").bitwiseAND(FLAG_REVERSE) != 0).cast("int")
    placed = rows.select("contig", start.alias("contig_position"), "cigar", "seq", "base_quals", "map_q", reverse.alias("is_reverse"), *(c.alias(n) for n, c in carried.items()), F.explode(bins).alias("bin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _whole_bins(batches, width):
            yield from function(found)

    return placed.repartition("contig", "bin").sortWithinPartitions("contig", "bin").mapInArrow(run, schema)


def added(total: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray, cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts (keys, keys by n) with one more for each key and cell below n."""
    own, code = np.unique(keys, return_inverse=True)
    counts = np.bincount(code * n + cells, minlength=len(own) * n).reshape(len(own), n)
    return (own, counts) if total is None else _summed(np.concatenate([total[0], own]), np.concatenate([total[1], counts]))


def base_counts(bins: Bins) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts of the four regular bases), at positions that have any."""
    total = None
    for b in bins.blocks():
        regular = b.base < len(LETTERS)
        total = added(total, b.key[regular], b.base[regular], len(LETTERS))
    return total


def placed_among(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each wanted key is among the sorted keys, whether it is there)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def letter_array(codes: np.ndarray) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32()), pa.array(list(LETTERS))).cast(pa.string())


def mismatches(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(record_id, position, qual): bases that differ from the most frequent regular base of their position, the first in the alphabet of equals."""

    def found(bins: Bins) -> Iterator[pa.RecordBatch]:
        keys, counts = base_counts(bins)
        ref = counts.argmax(axis=1)
        for b in bins.blocks():
            regular = np.flatnonzero(b.base < len(LETTERS))
            wrong = regular[b.base[regular] != ref[np.searchsorted(keys, b.key[regular])]]
            if len(wrong):
                yield pa.RecordBatch.from_arrays([b.rows.column("record_id").take(pa.array(b.read[wrong])), bins.locus(b.key[wrong])[1], pa.array(b.qual[wrong].astype(np.int32), mask=~b.has_qual[wrong])], names=["record_id", "position", "qual"])

    return walked(rows, {"record_id": F.col("record_id")}, found, "record_id bigint, position bigint, qual int", width)
