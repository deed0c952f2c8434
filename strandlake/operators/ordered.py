"""Ordered folds along positions at any size: the row before, running counts and islands.

A window over a whole entity would sort all its rows in one task. These work per stretch of positions; what a stretch needs from before it
(its predecessor's last row, the count so far) comes from a table with one row per stretch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators.periods import STRETCH
from strandlake.session import staged


def _on(keys: list[str]) -> list[Column]:
    return [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_stretch"]]


def with_previous(rows: DataFrame, keys: list[str], at: str, ties: list[str], carried: list[str], out: str = "prev", stretch: int = STRETCH) -> DataFrame:
    """Add ``out``: a struct of the ``carried`` columns of the row before (by ``at``, then ``ties``) of the same keys; null for the first."""
    cells = rows.withColumn("_stretch", F.floor(F.col(at) / stretch)).withColumn("_s", F.struct(*carried))
    inner = W.partitionBy(*keys, "_stretch").orderBy(at, *ties)
    last = cells.groupBy(*keys, "_stretch").agg(F.max_by("_s", F.struct(at, *ties)).alias("_last"))
    last = last.select(*keys, "_stretch", F.lag("_last").over(W.partitionBy(*keys).orderBy("_stretch")).alias("_before"))
    here = cells.withColumns({"_lag": F.lag("_s").over(inner), "_n": F.row_number().over(inner)})
    joined = here.alias("a").join(last.alias("b"), _on(keys)).select("a.*", "b._before")
    return joined.withColumn(out, F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_lag"))).drop("_stretch", "_s", "_lag", "_n", "_before")


def with_running_count(rows: DataFrame, keys: list[str], at: str, ties: list[str], flag: str, out: str, stretch: int = STRETCH) -> DataFrame:
    """Add ``out``: how many rows up to and with this one have ``flag`` set."""
    cells = rows.withColumn("_stretch", F.floor(F.col(at) / stretch))
    one = F.col(flag).cast("bigint")
    inner = W.partitionBy(*keys, "_stretch").orderBy(at, *ties).rowsBetween(W.unboundedPreceding, 0)
    sums = cells.groupBy(*keys, "_stretch").agg(F.sum(one).alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "_stretch", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    here = cells.withColumn("_run", F.sum(one).over(inner))
    return here.alias("a").join(sums.alias("b"), _on(keys)).select("a.*", (F.col("b._before") + F.col("a._run")).alias(out)).drop("_stretch", "_run")


def with_island(rows: DataFrame, keys: list[str], at: str, ties: list[str], carried: list[str], begins: Callable[[Column], Column], out: str = "island") -> DataFrame:
    """Add ``out``: the number of the run of rows that this one belongs to; ``begins(previous)`` says if a row begins one."""
    marked = with_previous(staged(rows, "ordered-rows"), keys, at, ties, carried, "_prev")
    marked = marked.withColumn("_begins", F.col("_prev").isNull() | F.coalesce(begins(F.col("_prev")), F.lit(True))).drop("_prev")
    marked = staged(marked, "ordered-marks")  # both steps read their rows twice
    return with_running_count(marked, keys, at, ties, "_begins", out).drop("_begins")
