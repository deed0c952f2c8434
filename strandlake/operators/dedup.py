"""Removal of duplicate fragments: of all pairs (or single ends) at the same places, the one with the largest sum of mapping qualities stays.

Keys are structs of (contig, position, strand) of both ends, so different places never share a key. The best of a key comes from an aggregate
that is partial before the shuffle; rows are joined back by fragment name. Ties go to the smaller name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake import tables as t
from strandlake.tables import contig_key, with_contig, with_sample

#: Fixed value: unmapped, secondary, duplicate and supplementary reads don't vote.
NO_VOTE = 3332


def fragment_name() -> F.Column:
    """The read name without a mate suffix."""
    return F.regexp_replace("read_name", "/[12]$", "")


def best_fragments(reads: DataFrame, read_groups: DataFrame, contigs: DataFrame) -> DataFrame:
    """Voting reads of the best fragment of each key, with their sample and contig."""
    votes = reads.where((F.col("flag").bitwiseAND(NO_VOTE) == 0) & (F.col("contig_position") >= 1))
    votes = with_sample(with_contig(votes, contigs, "contig_name", "contig_id", out="_contig", code="_code"), read_groups, out="_sample").where("_code is not null")
    votes = votes.withColumn("_name", fragment_name())
    own = F.struct(F.col("_code").alias("c"), F.col("contig_position").cast("bigint").alias("p"), (F.col("flag").bitwiseAND(t.FLAG_REVERSE) != 0).alias("s"))
    mates = contigs.select(contig_key(F.col("contig_name")).alias("_mkey"), F.col("contig_id").alias("_mid"))
    votes = votes.withColumn("_mkey", F.when(F.trim("mate_contig_name") == "=", contig_key(F.col("_contig"))).otherwise(contig_key(F.col("mate_contig_name")))).join(mates, "_mkey", "left")
    has_mate = (F.col("flag").bitwiseAND(t.FLAG_PAIRED) != 0) & (F.col("flag").bitwiseAND(t.FLAG_MATE_UNMAPPED) == 0) & F.col("_mid").isNotNull() & (F.col("mate_position") >= 1)
    mate = F.when(has_mate, F.struct(F.col("_mid").alias("c"), F.col("mate_position").cast("bigint").alias("p"), (F.col("flag").bitwiseAND(t.FLAG_MATE_REVERSE) != 0).alias("s")))
    fragments = votes.groupBy("_sample", "_name").agg(F.min(own).alias("a"), F.max(own).alias("b"), F.max(mate).alias("m"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("map_q", F.lit(0))).alias("score"))
    lone = (F.col("n") == 1) & F.col("m").isNotNull()
    keyed = fragments.select("_sample", "_name", "score", F.when(lone, F.least("a", "m")).otherwise(F.col("a")).alias("k1"), F.when(lone, F.greatest("a", "m")).when(F.col("n") > 1, F.col("b")).alias("k2"))
    best = keyed.groupBy("_sample", "k1", "k2").agg(F.min(F.struct(-F.col("score"), "_name")).alias("best")).select("_sample", F.col("best._name").alias("_name"))
    return votes.drop("_mkey", "_mid").join(best, [votes["_sample"].eqNullSafe(best["_sample"]), votes["_name"] == best["_name"]], "left_semi")


def deduplicated(reads: DataFrame, read_groups: DataFrame, contigs: DataFrame, mate_unmapped_rule: bool = True) -> DataFrame:
    """The reads that stay, with ``_sample``, ``_contig`` and ``_code``.

    mate_unmapped_rule: where reads with an unmapped mate begin, only such reads stay.
    """
    best = best_fragments(reads, read_groups, contigs).drop("_name")
    if not mate_unmapped_rule:
        return best
    place = ["_sample", "_code", "contig_position"]
    lost = F.col("flag").bitwiseAND(t.FLAG_MATE_UNMAPPED) != 0
    rules = best.where(lost).select(*(F.col(c).alias(f"{c}_") for c in place)).distinct()
    same = [best["_sample"].eqNullSafe(rules["_sample_"]), best["_code"] == rules["_code_"], best["contig_position"] == rules["contig_position_"]]
    return best.join(rules, same, "left").where(rules["_code_"].isNull() | lost).drop(*rules.columns)


def flagged(reads: DataFrame, read_groups: DataFrame, contigs: DataFrame) -> DataFrame:
    """All reads; those of fragments that lost have the duplicate bit set."""
    kept = deduplicated(reads, read_groups, contigs).select(F.col("record_id").alias("_kept"))
    joined = reads.join(kept, reads["record_id"] == kept["_kept"], "left")
    lost = (F.col("flag").bitwiseAND(NO_VOTE) == 0) & F.col("_kept").isNull() & (F.col("contig_position") >= 1)
    return joined.withColumn("flag", F.when(lost, F.col("flag").bitwiseOR(t.FLAG_DUPLICATE)).otherwise(F.col("flag"))).drop("_kept")
