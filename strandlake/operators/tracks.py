"""Features of several tracks at loci: what overlaps, what starts there, the first, and the one of the preferred track.

A track is a table of features (contig, from_position, to_position, name, kind). All come from one range join with the loci, whose rows
stand for (locus, feature) pairs; no locus gathers its features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators import intervals

FEATURE = ["contig", "from_position", "to_position", "name", "kind"]


def together(tracks: dict[str, DataFrame]) -> DataFrame:
    """The tracks of a chain as one table with ``track``. A name that two chains share must be of one track."""
    out = None
    for name, df in tracks.items():
        rows = df.select(F.lit(name).alias("track"), *FEATURE)
        out = rows if out is None else out.unionByName(rows)
    return out


def values_at(loci: DataFrame, features: DataFrame, width: int = 1 << 12) -> DataFrame:
    """(contig, position, track and the feature's columns) of the features that cover each locus."""
    points = loci.select("contig", "position", F.col("position").alias("_to")).distinct()
    return intervals.range_join(points, features, ["contig"], "position", "_to", "from_position", "to_position", width).drop("_to")


def at_exact_start(values: DataFrame) -> DataFrame:
    return values.where(F.col("from_position") == F.col("position"))


def of_kind(values: DataFrame, kind: str) -> DataFrame:
    return values.where(F.col("kind") == kind)


def priority(order: list[str]) -> Column:
    """The place of a row's track in a list of priorities; tracks not in it come last."""
    at = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("track"))
    return F.when(at > 0, at).otherwise(len(order) + 1)


def first_value(values: DataFrame, order: list[str]) -> DataFrame:
    """One feature per locus: of the track that comes first in ``order``, of its features the one that starts first, by name among equals."""
    rank = F.struct(priority(order).alias("p"), "from_position", "name", "to_position", "kind", "track")
    best = values.groupBy("contig", "position").agg(F.min(rank).alias("b"))
    return best.select("contig", "position", *(F.col(f"b.{c}").alias(c) for c in ("track", "from_position", "to_position", "name", "kind")))


def sorted_by_priority(values: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``place``: the number of features of the locus that come before, by track priority, start and name. Counted per locus from ranks of distinct features."""
    return values.withColumn("place", F.row_number().over(W.partitionBy("contig", "position").orderBy(priority(order), "from_position", "name", "to_position")))
