"""Queries that change reads: cutting, mending of mates and realignment. Tested against plain walks; without SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import clipping, pileup, realignment, reference
from strandlake.queries.pileups import _consensus
from strandlake.queries.somatics import event_targets
from strandlake.session import staged
from strandlake.tables import table


def _tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [table(spark, sf, n) for n in ("reads", "read_groups", "contigs")]


def finalized_reads(spark: SparkSession, sf: str) -> DataFrame:
    rows = pileup.read_rows(*_tables(spark, sf)).where("seq not in ('', '*') and base_quals not in ('', '*')")
    return clipping.finalized(rows).select("record_id", "cut.start", "cut.cigar", "cut.seq", "cut.base_quals")


def reverted_clips(spark: SparkSession, sf: str) -> DataFrame:
    rows = pileup.read_rows(*_tables(spark, sf)).where("seq not in ('', '*') and base_quals not in ('', '*') and cigar like '%S%'")
    return clipping.finalized(rows, low=-1, keep_soft_clips=True).select("record_id", "cut.start", "cut.cigar", F.length("cut.seq").alias("n"))


def mended_mates(spark: SparkSession, sf: str) -> DataFrame:
    rows = pileup.read_rows(*_tables(spark, sf)).where("seq not in ('', '*') and base_quals not in ('', '*')")
    return clipping.mended_mates(rows)


def realigned_reads(spark: SparkSession, sf: str) -> DataFrame:
    refs = staged(reference.slices(_consensus(spark, sf)), "reference-slices")
    return realignment.realigned(staged(event_targets(spark, sf), "targets"), *_tables(spark, sf), refs, table(spark, sf, "variants"))


QUERIES = {f.__name__: f for f in (finalized_reads, reverted_clips, mended_mates, realigned_reads)}
ORACLES: dict[str, str] = {}
