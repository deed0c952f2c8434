"""Queries on document texts. Their results depend on a tokenizer or on text rules, so they have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import mixing, packing, quality, tokens
from strandlake.session import staged
from strandlake.tables import table


def p6_assignments(spark: SparkSession, sf: str) -> DataFrame:
    sizes = staged(tokens.token_counts(table(spark, sf, "documents"), ["doc_id"]), "doc-tokens")
    return packing.pack(sizes, table(spark, sf, "pack_limits"))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fills(p6_assignments(spark, sf), table(spark, sf, "pack_limits"))


def p6_summary(spark: SparkSession, sf: str) -> DataFrame:
    per = p6_containers(spark, sf).groupBy("pack_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("used_tokens").alias("used_tokens"), F.sum("n_items").alias("n_items"))
    return per.withColumn("unused_share", 1 - F.col("used_tokens") / (F.col("containers") * F.col("capacity_tokens")))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sizes = tokens.token_counts(table(spark, sf, "documents"), ["doc_id", "source"])
    return mixing.mix(sizes, table(spark, sf, "mix_targets"), fractions=(0.1, 0.5, 1.0))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.text_quality(table(spark, sf, "documents")).where(F.col("kind") != "prose").select("doc_id")


def p8_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.text_quality(table(spark, sf, "documents"))


def p8_label_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by their label and the kind found; the labels are only compared with, nothing is fitted to them."""
    found = quality.text_quality(table(spark, sf, "documents")).join(table(spark, sf, "doc_labels"), "doc_id")
    return found.groupBy("label", "kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p6_assignments, p6_containers, p6_summary, p7_mixture, p7_shares, p8_found, p8_quality, p8_label_agreement)}
ORACLES: dict[str, str] = {}
