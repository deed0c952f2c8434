"""Loading of the tables and unification of contig and sample names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the data model: the id of "no contig" and the flag bits of an aligned read.
NO_CONTIG = 255
FLAG_PAIRED, FLAG_PROPER, FLAG_UNMAPPED, FLAG_MATE_UNMAPPED = 1, 2, 4, 8
FLAG_REVERSE, FLAG_MATE_REVERSE, FLAG_FIRST, FLAG_SECOND = 16, 32, 64, 128
FLAG_SECONDARY, FLAG_QC_FAIL, FLAG_DUPLICATE, FLAG_SUPPLEMENTARY = 256, 512, 1024, 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contig_key(name: Column) -> Column:
    """The name without blanks around it and a leading ``chr``; M as MT; null for no contig (empty, ``*``)."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), r"^[cC][hH][rR]", "")
    return F.when(bare == "M", F.lit("MT")).when(bare.isin("", "*"), F.lit(None).cast("string")).otherwise(bare)


def with_contig(df: DataFrame, contigs: DataFrame, name: str = "contig_name", contig_id: str | None = None, out: str = "contig", code: str | None = None) -> DataFrame:
    """Add ``out``, the dictionary's spelling of the contig (null where it has none), and its id as ``code``.

    ``contig_id`` names a column that decides where the name is null. The dictionary is joined on the unified
    name, so Spark broadcasts it only while its size, known from its files, is below the broadcast limit.
    """
    known = contigs.select(contig_key(F.col("contig_name")).alias("_ckey"), F.col("contig_name").alias("_cname"), F.col("contig_id").alias("_cid"))
    known = known.groupBy("_ckey").agg(F.min_by("_cname", "_cid").alias("_cname"), F.min("_cid").alias("_cid"))
    got = df.withColumn("_ckey", contig_key(F.col(name))).join(known, "_ckey", "left")
    if contig_id:
        by_id = contigs.select(F.col("contig_id").alias("_iid"), F.col("contig_name").alias("_iname")).groupBy("_iid").agg(F.min("_iname").alias("_iname"))
        lookup = F.when(F.col(name).isNull(), F.col(contig_id))
        got = got.withColumn("_iid", lookup).join(by_id, "_iid", "left").withColumns({"_cid": F.coalesce("_cid", F.when(F.col("_iname").isNotNull(), F.col("_iid"))), "_cname": F.coalesce("_cname", "_iname")}).drop("_iid", "_iname")
    got = got.withColumn(out, F.col("_cname"))
    return (got.withColumn(code, F.col("_cid")) if code else got).drop("_ckey", "_cname", "_cid")


def with_sample(df: DataFrame, read_groups: DataFrame, out: str = "sample") -> DataFrame:
    """Add the sample of ``read_group``; null where the group is null or unknown."""
    groups = read_groups.select(F.col("read_group").alias("_rg"), F.col("sample_name").alias(out)).groupBy("_rg").agg(F.min(out).alias(out))
    return df.join(groups, df["read_group"] == F.col("_rg"), "left").drop("_rg")
