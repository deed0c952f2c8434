"""Counts per position from one exchange of reads.

Reads go to the bins of positions that they overlap and are sorted by their start there, so one pass over a partition knows when no
read to come can reach a position. Positions are counted with numpy in that pass, and each comes out once, with nothing to add up after it: what is
shuffled is reads, not bases. Memory is that of a batch of reads and of the positions they still reach.

Bins with far more reads than the rest (as a shared start with a third of all reads) are found first from a count of reads per bin. Their
reads are dealt to several tasks by a hash, and only their positions are summed once more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import cigar as C
from strandlake.kernels import columns as K
from strandlake.operators import pileup
from strandlake.tables import FLAG_REVERSE

#: Positions of a bin, and reads of a bin from which it is dealt to several tasks.
WIDTH, HOT_READS = 1 << 14, 1 << 20
BASES = "ACGTN"
COUNTERS = ["deletions", *(f"{b}_{s}" for b in (*BASES.lower(), "other") for s in ("forward", "reverse")), "map_q_zero", "insertions_follow", "deletions_follow"]
_SCHEMA = "contig string, position bigint, " + ", ".join(f"{c} bigint" for c in COUNTERS)
_CONTIG_SHIFT = 40
_BASE_CLASS = np.full(256, len(BASES), np.int64)
for _i, _b in enumerate(BASES):
    _BASE_CLASS[ord(_b)] = _i


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal keys as one, sorted."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(batch: pa.RecordBatch, contig_code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    starts = batch.column("contig_position").to_numpy(zero_copy_only=False).astype(np.int64)
    first = batch.column("bin").to_numpy(zero_copy_only=False).astype(np.int64) * width + 1
    els = K.elements(batch.column("cigar").to_pylist(), starts)
    inside = (els.position >= first[els.read]) & (els.position < first[els.read] + width)
    read, position, deletion, next_op = els.read[inside], els.position[inside], els.deletion[inside], els.next_op[inside]
    base = K.upper(K.picked(K.letters(batch.column("seq").to_pylist()), read, els.offset[inside]))
    reverse = batch.column("is_reverse").to_numpy(zero_copy_only=False).astype(np.int64)[read]
    zero = (batch.column("map_q").fill_null(-1).to_numpy(zero_copy_only=False) == 0)[read]
    keys, code = np.unique((contig_code[read] << _CONTIG_SHIFT) + position, return_inverse=True)
    n = len(COUNTERS)
    marks = [(np.flatnonzero(deletion), 0), (np.flatnonzero(~deletion), 1 + 2 * _BASE_CLASS[base] + reverse), (np.flatnonzero(zero), n - 3), (np.flatnonzero(~deletion & (next_op == K.INSERTION)), n - 2), (np.flatnonzero(~deletion & (next_op == K.DELETION)), n - 1)]
    cells = np.concatenate([code[at] * n + (counter if np.isscalar(counter) else counter[at]) for at, counter in marks])
    return keys, np.bincount(cells, minlength=len(keys) * n).reshape(len(keys), n)


def _tally(width: int):
    def counted(batches):
        names: list[str] = []
        keys, counts = np.zeros(0, np.int64), np.zeros((0, len(COUNTERS)), np.int64)

        def out(below: int | None):
            nonlocal keys, counts
            done = len(keys) if below is None else int(np.searchsorted(keys, below))
            ready_keys, ready = keys[:done], counts[:done]
            keys, counts = keys[done:], counts[done:]
            contig = pa.DictionaryArray.from_arrays(pa.array(ready_keys >> _CONTIG_SHIFT, pa.int32()), pa.array(names, pa.string())).cast(pa.string())
            return pa.RecordBatch.from_arrays([contig, pa.array(ready_keys & ((1 << _CONTIG_SHIFT) - 1)), *(pa.array(np.ascontiguousarray(ready[:, i])) for i in range(len(COUNTERS)))], names=["contig", "position", *COUNTERS])

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("contig").dictionary_encode()
            places = []
            for name in coded.dictionary.to_pylist():  # contigs come one after the other
                if not names or names[-1] != name:
                    names.append(name)
                places.append(len(names) - 1)
            contig_code = np.array(places, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
            more_keys, more = _counted(batch, contig_code, width)
            keys, counts = _summed(np.concatenate([keys, more_keys]), np.concatenate([counts, more]))
            last = batch.num_rows - 1
            reach = max(batch.column("contig_position")[last].as_py(), batch.column("bin")[last].as_py() * width + 1)
            yield out((int(contig_code[last]) << _CONTIG_SHIFT) + reach)
        if len(keys):
            yield out(None)

    return counted


def position_counts(reads: DataFrame, read_groups: DataFrame, contigs: DataFrame, preset: str = "locus_walker", width: int = WIDTH, hot_reads: int = HOT_READS) -> DataFrame:
    """(contig, position and the ``COUNTERS``) of every position that a filtered read covers. Rows of ``pileup.elements`` counted, without making them."""
    rows = pileup.read_rows(reads, read_groups, contigs, preset).where(F.col("seq").isNotNull() & ~F.col("seq").isin("", "*"))
    return counts_of(rows, width, hot_reads)


def counts_of(rows: DataFrame, width: int = WIDTH, hot_reads: int = HOT_READS) -> DataFrame:
    """``position_counts`` of placed rows (contig, contig_position, cigar, seq, map_q, flag)."""
    start = F.col("contig_position").cast("bigint")
    last = start + F.greatest(C.reference_length(F.col("cigar")), F.lit(1)) - 1
    bins = F.sequence(F.expr(f"(contig_position - 1) div {width}"), F.floor((last - 1) / width).cast("bigint"))
    placed = rows.select("contig", start.alias("contig_position"), "cigar", "seq", "map_q", (F.col("flag").bitwiseAND(FLAG_REVERSE) != 0).alias("is_reverse"), F.explode(bins).alias("bin"))
    hot = placed.groupBy("contig", "bin").agg(F.count(F.lit(1)).alias("_reads")).where(F.col("_reads") > hot_reads).select("contig", "bin", F.expr(f"(_reads + {hot_reads - 1}) div {hot_reads}").alias("_tasks"))
    hot_bins = [(r["contig"], r["bin"], r["_tasks"]) for r in hot.collect()]  # at most the number of reads over ``hot_reads``
    sorted_by = ["contig", "bin", "contig_position"]
    if not hot_bins:
        return placed.repartition("contig", "bin").sortWithinPartitions(*sorted_by).mapInArrow(_tally(width), _SCHEMA)
    marks = rows.sparkSession.createDataFrame(hot_bins, "contig string, bin bigint, _tasks bigint")
    usual = placed.join(marks, ["contig", "bin"], "left_anti").repartition("contig", "bin").sortWithinPartitions(*sorted_by).mapInArrow(_tally(width), _SCHEMA)
    dealt = placed.join(marks, ["contig", "bin"]).withColumn("_task", F.pmod(F.xxhash64("seq", "cigar", "contig_position", F.monotonically_increasing_id()), F.col("_tasks")))
    parts = dealt.repartition("contig", "bin", "_task").drop("_tasks", "_task").sortWithinPartitions(*sorted_by).mapInArrow(_tally(width), _SCHEMA)
    return usual.unionByName(parts.groupBy("contig", "position").agg(*(F.sum(c).alias(c) for c in COUNTERS)))


def _of(base: str) -> Column:
    return F.col(f"{base}_forward") + F.col(f"{base}_reverse")


def _strand(side: str) -> Column:
    return sum((F.col(f"{b}_{side}") for b in (*BASES.lower()[1:], "other")), F.col(f"a_{side}"))


def base_counts(counts: DataFrame) -> DataFrame:
    """Depth, deletions, bases by letter, strands, mapping quality 0 and indels that follow, per position."""
    forward, reverse = _strand("forward"), _strand("reverse")
    return counts.select("contig", "position", (forward + reverse).alias("depth"), "deletions", *(_of(b).alias(f"n_{b}") for b in BASES.lower()), forward.alias("forward"), reverse.alias("reverse"), "map_q_zero", "insertions_follow", "deletions_follow")


def _regular() -> Column:
    """The four regular bases with their counts: the most frequent first, of equals the first in the alphabet."""
    return F.array_sort(F.array(*(F.struct((-_of(b)).alias("n"), F.lit(b.upper()).alias("base"), F.col(f"{b}_forward").alias("f"), F.col(f"{b}_reverse").alias("r")) for b in "acgt")))


def consensus(counts: DataFrame) -> DataFrame:
    """(contig, position, ref): the most frequent regular base of each position, the first in the alphabet of equals."""
    most = F.greatest(*(_of(b) for b in "acgt"))
    ref = F.when(_of("a") == most, "A").when(_of("c") == most, "C").when(_of("g") == most, "G").otherwise("T")
    return counts.where(most > 0).select("contig", "position", ref.alias("ref"))


def strand_tables(counts: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """(contig, position, ref, alt, ref_forward, ref_reverse, alt_forward, alt_reverse) where a base differs from the reference (or from the consensus); alt is the most frequent such base."""
    # Where only one base was seen, nothing can differ from the consensus.
    shown = sum(((_of(b) > 0).cast("int") for b in "acgt"), F.lit(0))
    rows = counts.where(shown > (0 if refs is not None else 1)).select("contig", "position", _regular().alias("b"))
    rows = rows.join(refs, ["contig", "position"]) if refs is not None else rows.withColumn("ref", F.col("b")[0]["base"])
    own, alt = F.get(F.filter("b", lambda x: x["base"] == F.col("ref")), F.lit(0)), F.get(F.filter("b", lambda x: x["base"] != F.col("ref")), F.lit(0))
    found = rows.select("contig", "position", "ref", own.alias("o"), alt.alias("a")).where("a.n < 0")
    zero = F.lit(0).cast("bigint")
    return found.select("contig", "position", "ref", F.col("a.base").alias("alt"), F.coalesce("o.f", zero).alias("ref_forward"), F.coalesce("o.r", zero).alias("ref_reverse"), F.col("a.f").alias("alt_forward"), F.col("a.r").alias("alt_reverse"))
