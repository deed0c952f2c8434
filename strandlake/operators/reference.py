"""A reference sequence as slices of fixed length, and reads with the reference they cover.

Slices are keyed by (contig, slice), so a read meets one or two of them in a hash join; the sequence is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import tallies, walks

#: Bases of a slice.
SLICE = 4096


def slices(bases: DataFrame, size: int = SLICE) -> DataFrame:
    """(contig, slice, seq) from (contig, position, ref); positions without a base are N."""

    @F.pandas_udf("string")
    def filled(offsets: pd.Series, letters: pd.Series) -> pd.Series:
        out = []
        for at, base in zip(offsets, letters, strict=True):
            line = np.full(size, ord("N"), np.uint8)
            line[np.asarray(at, np.int64)] = [ord(b) for b in base]
            out.append(line.tobytes().decode())
        return pd.Series(out)

    index = F.expr(f"(position - 1) div {size}")
    packed = bases.withColumn("slice", index).groupBy("contig", "slice").agg(F.collect_list(F.struct((F.col("position") - 1 - F.col("slice") * size).alias("o"), F.col("ref").alias("b"))).alias("p"))
    return packed.select("contig", "slice", filled(F.col("p.o"), F.col("p.b")).alias("seq"))


def read_slices(rows: DataFrame, size: int = SLICE) -> DataFrame:
    """``slices`` of the consensus of placed reads (``pileup.read_rows``), from one exchange of reads and without a row per base. The size divides that of a bin."""
    if tallies.WIDTH % size:
        raise ValueError("a slice must lie in one bin")

    def found(bins: walks.Bins) -> Iterator[pa.RecordBatch]:
        keys, counts = walks.base_counts(bins)
        if not len(keys):
            return
        letter = np.frombuffer(walks.LETTERS.encode(), np.uint8)[counts.argmax(axis=1)]
        own, line = np.unique(((keys >> walks._CONTIG_SHIFT) << walks._CONTIG_SHIFT) + ((keys & ((1 << walks._CONTIG_SHIFT) - 1)) - 1) // size, return_inverse=True)
        lines = np.full((len(own), size), ord("N"), np.uint8)
        lines[line, ((keys & ((1 << walks._CONTIG_SHIFT) - 1)) - 1) % size] = letter
        flat = lines.tobytes().decode()
        yield pa.RecordBatch.from_arrays([*bins.locus(own), pa.array([flat[i * size : (i + 1) * size] for i in range(len(own))], pa.string())], names=["contig", "slice", "seq"])

    return walks.walked(rows, {}, found, "contig string, slice bigint, seq string")


def overlapping(refs: DataFrame, margin: int, size: int = SLICE) -> DataFrame:
    """(contig, slice, seq) of slices that go on for ``margin`` positions into the next one; N where the reference has no slice."""
    head = F.struct(F.col("slice").alias("slice"), F.col("seq").alias("own"), F.lit(None).cast("string").alias("next"))
    tail = F.struct((F.col("slice") - 1).alias("slice"), F.lit(None).cast("string").alias("own"), F.left("seq", F.lit(margin)).alias("next"))
    parts = refs.select("contig", F.inline(F.array(head, tail))).groupBy("contig", "slice").agg(F.max("own").alias("own"), F.max("next").alias("next"))
    return parts.select("contig", "slice", F.concat(F.coalesce("own", F.lit("N" * size)), F.coalesce("next", F.lit("N" * margin))).alias("seq"))


def bases(refs: DataFrame, size: int = SLICE) -> DataFrame:
    """(contig, position, ref) of slices, without N."""
    letters = refs.select("contig", "slice", F.posexplode(F.split("seq", "")).alias("o", "ref"))
    return letters.where("ref not in ('', 'N')").select("contig", (F.col("slice") * size + F.col("o") + 1).alias("position"), F.upper("ref").alias("ref"))


def with_reference(rows: DataFrame, refs: DataFrame, start: str, end: str, key: str = "record_id", padding: int = 0, size: int = SLICE, out: str = "ref_seq") -> DataFrame:
    """Add the reference from ``start`` to ``end`` with ``padding`` on both sides; N where there is none. ``key`` is unique."""
    lo, hi = F.greatest(F.lit(1), F.col(start) - padding).cast("bigint"), (F.col(end) + padding).cast("bigint")
    wanted = rows.select(F.col(key).alias("_key"), "contig", lo.alias("_lo"), hi.alias("_hi"))
    spread = wanted.withColumn("slice", F.explode(F.sequence(F.expr(f"(_lo - 1) div {size}"), F.expr(f"(_hi - 1) div {size}"))))
    found = spread.join(refs, ["contig", "slice"], "left").withColumn("seq", F.coalesce("seq", F.lit("N" * size)))
    first, last = F.greatest(F.col("_lo") - 1 - F.col("slice") * size, F.lit(0)), F.least(F.col("_hi") - F.col("slice") * size, F.lit(size))
    piece = F.substring("seq", (first + 1).cast("int"), (last - first).cast("int"))
    joined = found.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("slice", piece.alias("s")))).alias("_p"), F.first("_lo").alias("ref_start"))
    joined = joined.select("_key", "ref_start", F.concat_ws("", F.col("_p.s")).alias(out))
    return rows.join(joined, rows[key] == joined["_key"]).drop("_key")


def on_slices(rows: DataFrame, refs: DataFrame, span: str, extra: int = 0, margin: int = 512, size: int = SLICE) -> DataFrame:
    """Rows (record_id, contig, contig_position, ``span``) with ``ref_seq`` from their position over the span and ``extra`` bases.

    A row meets the overlapping slice of its position in one equi-join and nothing is joined back; rows longer than the margin take the way over all slices.
    """
    wide = F.col(span) + extra
    near = overlapping(refs, margin, size).withColumnRenamed("seq", "_slice_seq")
    short = rows.where(wide <= margin).withColumn("slice", F.expr(f"(contig_position - 1) div {size}")).join(near, ["contig", "slice"])
    cut = F.substring("_slice_seq", (F.col("contig_position") - F.col("slice") * size).cast("int"), wide.cast("int"))
    short = short.withColumn("ref_seq", cut).select(*rows.columns, "ref_seq")
    long = with_reference(rows.where(wide > margin).withColumn("_end", F.col("contig_position") + wide - 1), refs, "contig_position", "_end")
    return short.unionByName(long.select(*rows.columns, "ref_seq"))
