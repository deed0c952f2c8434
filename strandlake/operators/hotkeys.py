"""Per-key counts, means and distinct counts whose cost doesn't depend on how rows spread over keys.

Each equal split of the input (``flush_rows`` rows) dictionary-encodes its keys (a contig by its id in the sequence dictionary, a site by contig and
position), scatters its rows into dense accumulators with numpy bincount, and hands on array blocks: for a range of keys, the offsets
that occurred with their sums, and the distinct pairs of offset and sample. A key with a third of all rows leaves a split as one element. Blocks are
summed in a tree: first for each (block, part, branch), a branch being a share of the splits, then for each (block, part) over the
branches, then over the parts. Sums go to a part by their split, pairs by a hash of offset and sample, so that equal pairs meet and parts share none:
distinct samples are exact, and no group holds more than the pairs of one part or the blocks of one branch. Parts and branches follow the number of splits.

Defined results: rows whose contig isn't in the dictionary form one key with contig null; a null position forms the key with
position null; null quals count as rows but not for the mean (null if there is none); null samples aren't counted as distinct;
repeated rows count; an empty table yields no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.session import expected_splits
from strandlake.tables import with_contig

#: Widest and narrowest block of sites in positions (powers of 2), rows a split holds before it scatters them, and splits whose blocks one group of a round sums.
WIDEST, NARROWEST, FLUSH_ROWS, FAN_IN = 20, 6, 1 << 20, 64

_POS_BITS = 42
_NULL_POS = -(1 << (_POS_BITS - 1))
_BLOCKS = "level int, contig int, block bigint, part int, branch int, offsets array<bigint>, n array<bigint>, qual_sum array<double>, qual_n array<bigint>, pair_offsets array<bigint>, pair_samples array<string>"
_COLUMNS = ["level", "contig", "block", "part", "branch", "offsets", "n", "qual_sum", "qual_n", "pair_offsets", "pair_samples"]
_SUMMED = "level int, contig int, block bigint, offsets array<bigint>, n array<bigint>, qual_sum array<double>, qual_n array<bigint>, samples array<bigint>"
_FLAT = "level int, contig int, contig_position bigint, n bigint, qual_sum double, qual_n bigint, samples bigint"


def _lists(bounds: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def _bounds(sorted_ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where the runs of ``of`` begin in ``sorted_ids``, and the end."""
    return np.append(np.searchsorted(sorted_ids, of), len(sorted_ids))


def _pair_parts(offset: np.ndarray, sample: np.ndarray, names: list[str], parts: int) -> np.ndarray:
    """The part of each pair of offset and sample, by a hash of both that is the same in every split."""
    if parts == 1 or not len(offset):
        return np.zeros(len(offset), np.int64)
    of_name = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in names], np.uint64)
    mixed = (of_name[sample] ^ (offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def scatter(contig: np.ndarray, position: np.ndarray, qual: np.ndarray, sample: np.ndarray, names: list[str], block_bits: int, parts: int, split: int = 0, branches: int = 1) -> list[pa.RecordBatch]:
    """Array blocks of one split's rows. contig: -1 for none; position: _NULL_POS for null; qual: NaN for null; sample: index into names, -1 for null."""
    has_qual = ~np.isnan(qual)
    own_part, branch = split % parts, split // parts % branches
    out = []
    for level in (0, 1):
        key = (contig + 1) if level == 0 else ((contig + 1) << _POS_BITS) + (position - _NULL_POS)
        keys, code = np.unique(key, return_inverse=True)  # the split's dictionary: dense codes
        size = len(keys)
        n = np.bincount(code, minlength=size)
        sums, counts = np.bincount(code[has_qual], weights=qual[has_qual], minlength=size), np.bincount(code[has_qual], minlength=size)
        width = np.int64(max(1, len(names)))
        pairs = np.unique(code[sample >= 0] * width + sample[sample >= 0])
        pair_code, pair_sample = pairs // width, pairs % width
        if level == 0:
            of_contig, block, offset = np.full(size, -1), np.zeros(size, np.int64), keys - 1
        else:
            offset = (keys & ((1 << _POS_BITS) - 1)) + _NULL_POS
            of_contig, block = (keys >> _POS_BITS) - 1, offset >> block_bits
        pair_part = _pair_parts(offset[pair_code], pair_sample, names, parts)
        # Blocks in the order of (contig, block, part); keys are sorted by contig and block already.
        heads, block_of_key = np.unique(np.stack([of_contig, block]), axis=1, return_inverse=True)
        block_of_key = block_of_key.reshape(-1)
        cell, pair_cell = block_of_key * parts + own_part, block_of_key[pair_code] * parts + pair_part
        ids = np.unique(np.concatenate([cell, pair_cell]))
        order, pair_order = np.argsort(cell, kind="stable"), np.argsort(pair_cell, kind="stable")
        starts, pair_starts = _bounds(cell[order], ids), _bounds(pair_cell[pair_order], ids)
        samples = pa.array(np.array([*names, ""], dtype=object)[pair_sample[pair_order]].tolist(), pa.string())
        columns = [
            pa.array(np.full(len(ids), level), pa.int32()),
            pa.array(heads[0][ids // parts], pa.int32()),
            pa.array(heads[1][ids // parts], pa.int64()),
            pa.array(ids % parts, pa.int32()),
            pa.array(np.full(len(ids), branch), pa.int32()),
            _lists(starts, pa.array(offset[order], pa.int64())),
            _lists(starts, pa.array(n[order], pa.int64())),
            _lists(starts, pa.array(sums[order], pa.float64())),
            _lists(starts, pa.array(counts[order], pa.int64())),
            _lists(pair_starts, pa.array(offset[pair_code][pair_order], pa.int64())),
            _lists(pair_starts, samples),
        ]
        out.append(pa.RecordBatch.from_arrays(columns, names=_COLUMNS))
    return out


def _scatter_splits(block_bits: int, parts: int, flush_rows: int, branches: int):
    def mapped(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        held: list[pa.RecordBatch] = []
        rows, split = 0, context.partitionId() if context else 0

        def flush():
            t = pa.Table.from_batches(held)
            contig = t.column("code").fill_null(-1).to_numpy().astype(np.int64)
            position = t.column("position").fill_null(_NULL_POS).to_numpy()
            qual = t.column("qual").fill_null(float("nan")).to_numpy()
            coded = t.column("sample").combine_chunks().dictionary_encode()
            return scatter(contig, position, qual, coded.indices.fill_null(-1).to_numpy().astype(np.int64), coded.dictionary.to_pylist(), block_bits, parts, split, branches)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= flush_rows:
                yield from flush()
                held, rows = [], 0
        if held:
            yield from flush()

    return mapped


def _flat(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _sum_cells(t: pa.Table, offsets: np.ndarray, code: np.ndarray) -> dict[str, np.ndarray]:
    return {
        "n": np.bincount(code, weights=_flat(t, "n"), minlength=len(offsets)).astype(np.int64),
        "qual_sum": np.bincount(code, weights=_flat(t, "qual_sum"), minlength=len(offsets)),
        "qual_n": np.bincount(code, weights=_flat(t, "qual_n"), minlength=len(offsets)).astype(np.int64),
    }


def _one_row(t: pa.Table, keys: tuple[str, ...], values: dict) -> pa.Table:
    head = {k: t.column(k).slice(0, 1).combine_chunks() for k in keys}
    return pa.table(head | {k: pa.array([v], pa.list_(pa.float64() if k == "qual_sum" else pa.string() if k == "pair_samples" else pa.int64())) for k, v in values.items()})


def _distinct_pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(offset, sample code) of the distinct pairs, and the samples."""
    places, code = np.unique(_flat(t, "pair_offsets"), return_inverse=True)
    samples = t.column("pair_samples").combine_chunks().flatten().dictionary_encode()
    width = np.int64(max(1, len(samples.dictionary)))
    pairs = np.unique(code * width + samples.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    return places[pairs // width], pairs % width, samples.dictionary.to_pylist()


def _sum_branch(t: pa.Table) -> pa.Table:
    """A round before the first, where there are several branches: the blocks of one branch as one block."""
    offsets, code = np.unique(_flat(t, "offsets"), return_inverse=True)
    pair_offsets, pair_sample, names = _distinct_pairs(t)
    values = {"offsets": offsets} | _sum_cells(t, offsets, code) | {"pair_offsets": pair_offsets, "pair_samples": np.array([*names, ""], dtype=object)[pair_sample].tolist()}
    return _one_row(t, ("level", "contig", "block", "part", "branch"), values)


def _sum_splits(t: pa.Table) -> pa.Table:
    """The blocks of one part: sums of its splits, and how many of its distinct pairs each offset has."""
    pair_offsets, _, _ = _distinct_pairs(t)
    of_cells = _flat(t, "offsets")
    offsets = np.unique(np.concatenate([of_cells, pair_offsets]))
    values = {"offsets": offsets} | _sum_cells(t, offsets, np.searchsorted(offsets, of_cells)) | {"samples": np.bincount(np.searchsorted(offsets, pair_offsets), minlength=len(offsets)).astype(np.int64)}
    return _one_row(t, ("level", "contig", "block"), values)


def _sum_parts(t: pa.Table) -> pa.Table:
    """Last round: the parts, which share no split and no pair."""
    offsets, code = np.unique(_flat(t, "offsets"), return_inverse=True)
    level, contig = t.column("level")[0].as_py(), t.column("contig")[0].as_py()
    total = {k: np.bincount(code, weights=_flat(t, k), minlength=len(offsets)) for k in ("n", "qual_sum", "qual_n", "samples")}
    contigs, positions = (np.full(len(offsets), contig), offsets) if level else (offsets, np.zeros(len(offsets), np.int64))
    return pa.table(
        {
            "level": pa.array(np.full(len(offsets), level), pa.int32()),
            "contig": pa.array(contigs, pa.int32()),
            "contig_position": pa.array(positions, pa.int64()),
            "n": pa.array(total["n"].astype(np.int64)),
            "qual_sum": pa.array(total["qual_sum"]),
            "qual_n": pa.array(total["qual_n"].astype(np.int64)),
            "samples": pa.array(total["samples"].astype(np.int64)),
        }
    )


def tree_shape(splits: int, fan_in: int = FAN_IN) -> tuple[int, int]:
    """(parts, branches) for a number of splits: a group of a round has about ``fan_in`` splits to sum, and pairs spread over as many parts as branches."""
    parts = max(4, math.isqrt(max(1, splits) // fan_in))
    return parts, max(1, -(-splits // (parts * fan_in)))


def block_width(splits: int, fan_in: int = FAN_IN) -> int:
    """Bits of a block of sites: the more rows there are, the narrower, so that a block has about as many rows at any size."""
    return min(WIDEST, max(NARROWEST, WIDEST + (fan_in - 1).bit_length() - (max(1, splits) - 1).bit_length()))


def key_statistics(variants: DataFrame, contigs: DataFrame, block_bits: int | None = None, flush_rows: int = FLUSH_ROWS, fan_in: int = FAN_IN, splits: int | None = None) -> DataFrame:
    """Rows (key_level, contig_name, contig_position, n_rows, mean_qual, n_samples): ``contig`` with position 0 for each contig, ``site`` for each (contig, position).

    qual_sum and qual_n, which the mean is of, are given too. splits: how many are expected; by default from the size of the input's files.
    """
    splits = splits or expected_splits(variants)
    parts, branches = tree_shape(splits, fan_in)
    block_bits = block_width(splits) if block_bits is None else block_bits
    rows = with_contig(variants, contigs, "contig_name", "contig_id", out="_contig", code="_code").select(
        F.col("_code").cast("int").alias("code"), F.col("contig_position").cast("bigint").alias("position"), F.col("qual").cast("double").alias("qual"), F.col("sample_name").alias("sample")
    )
    blocks = rows.mapInArrow(_scatter_splits(block_bits, parts, flush_rows, branches), _BLOCKS)
    if branches > 1:
        blocks = blocks.groupBy("level", "contig", "block", "part", "branch").applyInArrow(_sum_branch, _BLOCKS)
    summed = blocks.groupBy("level", "contig", "block", "part").applyInArrow(_sum_splits, _SUMMED)
    flat = summed.groupBy("level", "contig", "block").applyInArrow(_sum_parts, _FLAT)
    names = contigs.groupBy("contig_id").agg(F.min("contig_name").alias("contig_name")).withColumnRenamed("contig_id", "contig")
    return flat.join(names, "contig", "left").select(
        F.when(F.col("level") == 0, "contig").otherwise("site").alias("key_level"),
        "contig_name",
        F.when(F.col("contig_position") != _NULL_POS, F.col("contig_position")).alias("contig_position"),
        F.col("n").alias("n_rows"),
        F.when(F.col("qual_n") > 0, F.col("qual_sum") / F.col("qual_n")).alias("mean_qual"),
        F.col("samples").alias("n_samples"),
        "qual_sum",
        "qual_n",
    )


def hot_keys(variants: DataFrame, contigs: DataFrame, contig_share: float = 0.08, site_share: float = 0.02) -> DataFrame:
    """The contigs and sites with more than their share of all rows; keys without a known contig or position are none."""
    total = variants.count()
    # A whole number is above a share of the total if it is above the share's whole part; taken exactly, not in floating point.
    contig_least, site_least = (math.floor(Fraction(str(share)) * total) for share in (contig_share, site_share))
    least = F.when(F.col("key_level") == "contig", contig_least).otherwise(site_least)
    kept = key_statistics(variants, contigs).where((F.col("n_rows") > least) & F.col("contig_name").isNotNull() & F.col("contig_position").isNotNull())
    return kept.select("key_level", "contig_name", "contig_position")
