"""Reads as aligned bases, and what is counted per position.

Reads are turned into rows per base inside the JVM: the CIGAR's operations get their reference and read offsets by one fold, each aligned
operation is exploded. Everything per position is then a hash aggregate with partial sums before its shuffle, so a deep position costs
its shuffle a row per task and base, not per read.

Defined results: reads without sequence have no bases, without qualities null ones; skipped reference (N) has no elements; deletions
are elements without base; positions without reads have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import cigar as C
from strandlake.functions.quality import quality_at
from strandlake.operators.filters import filtered
from strandlake.session import spread
from strandlake.tables import FLAG_REVERSE, with_contig, with_sample


def placed_operations(cigar: Column, start: Column) -> Column:
    """array<struct<op, len, ref, off, prev_op, next_op, next_len>>: ref is the reference position, off the 0-based read offset where the operation begins."""
    op_type = "array<struct<op:string,len:int,ref:bigint,off:int>>"
    zero = F.struct(start.cast("bigint").alias("ref"), F.lit(0).alias("off"), F.array().cast(op_type).alias("out"))

    def step(acc: Column, o: Column) -> Column:
        eats_ref, eats_read = o["op"].isin(*C.REFERENCE_OPS), o["op"].isin(*C.READ_OPS)
        here = F.struct(o["op"].alias("op"), o["len"].alias("len"), acc["ref"].alias("ref"), acc["off"].alias("off"))
        return F.struct((acc["ref"] + F.when(eats_ref, o["len"]).otherwise(0)).alias("ref"), (acc["off"] + F.when(eats_read, o["len"]).otherwise(0)).alias("off"), F.concat(acc["out"], F.array(here)).alias("out"))

    return F.aggregate(C.operations(cigar), zero, step, lambda acc: acc["out"])


def with_neighbours(ops: str) -> Column:
    return F.transform(ops, lambda o, i: o.withField("prev_op", F.get(ops, i - 1)["op"]).withField("next_op", F.get(ops, i + 1)["op"]).withField("next_len", F.get(ops, i + 1)["len"]))


def read_rows(reads: DataFrame, read_groups: DataFrame, contigs: DataFrame, preset: str = "locus_walker") -> DataFrame:
    """Filtered, placed reads with ``sample`` and ``contig``."""
    kept = filtered(spread(reads), preset).where(C.has_cigar(F.col("cigar")) & (F.col("contig_position") >= 1))
    return with_sample(with_contig(kept, contigs, "contig_name", "contig_id", out="contig"), read_groups).where("contig is not null")


def aligned_bases(reads: DataFrame, carried: list[str]) -> DataFrame:
    """One row per read and covered position: the ``carried`` columns and position, base, qual, read_offset, is_deletion, next_op, next_len (of an indel right after it), prev_op, inserted and before_clip.

    ``reads`` has contig_position, cigar, seq and base_quals.
    """
    text = lambda c: F.when(F.col(c).isin("", "*"), F.lit(None)).otherwise(F.col(c))
    rows = reads.withColumns({"_seq": text("seq"), "_quals": text("base_quals"), "_ops": placed_operations(F.col("cigar"), F.col("contig_position"))}).where("_seq is not null")
    rows = rows.select(*carried, "_seq", "_quals", F.inline(with_neighbours("_ops"))).where(F.col("op").isin("M", "=", "X", "D"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("i"))
    deletion, last = F.col("op") == "D", F.col("i") == F.col("len") - 1
    offset = F.when(deletion, F.col("off") - 1).otherwise(F.col("off") + F.col("i"))
    indel = last & F.col("next_op").isin("I", "D") & ~deletion
    return rows.select(
        *carried,
        (F.col("ref") + F.col("i")).alias("position"),
        F.when(~deletion, F.upper(F.substring("_seq", offset + 1, F.lit(1)))).alias("base"),
        F.when(~deletion, quality_at(F.col("_quals"), offset)).alias("qual"),
        offset.alias("read_offset"),
        deletion.alias("is_deletion"),
        F.when(indel, F.col("next_op")).alias("next_op"),
        F.when(indel, F.col("next_len")).alias("next_len"),
        F.when(F.col("i") == 0, F.col("prev_op")).alias("prev_op"),
        F.when(indel & (F.col("next_op") == "I"), F.substring("_seq", offset + 2, F.col("next_len"))).alias("inserted"),
        F.coalesce(last & (F.col("next_op") == "S"), F.lit(False)).alias("before_clip"),
    )


def elements(reads: DataFrame, read_groups: DataFrame, contigs: DataFrame, preset: str = "locus_walker", carried: list[str] = ()) -> DataFrame:
    """Pileup elements of all samples with the columns per-position operators need, and further columns of the reads (``carried``; ``read_start`` is the read's position)."""
    rows = read_rows(reads, read_groups, contigs, preset).withColumns({"is_reverse": F.col("flag").bitwiseAND(FLAG_REVERSE) != 0, "name": F.regexp_replace("read_name", "/[12]$", ""), "read_length": F.length("seq"), "read_start": F.col("contig_position").cast("bigint")})
    return aligned_bases(rows, ["record_id", "sample", "contig", "name", "is_reverse", "map_q", "read_group", "read_length", *carried])


LOCUS = ["contig", "position"]


def indels(rows: DataFrame) -> DataFrame:
    """(contig, position, next_op, next_len) of the ``elements`` of placed reads that an indel follows, from their operations: no row per base."""
    ops = rows.where(F.col("seq").isNotNull() & ~F.col("seq").isin("", "*") & F.col("cigar").rlike("[ID]")).select("contig", placed_operations(F.col("cigar"), F.col("contig_position")).alias("_ops"))
    found = ops.select("contig", F.inline(with_neighbours("_ops"))).where(F.col("op").isin("M", "=", "X") & F.col("next_op").isin("I", "D"))
    return found.select("contig", (F.col("ref") + F.col("len") - 1).alias("position"), "next_op", "next_len")


def base_counts(els: DataFrame, keys: list[str] = LOCUS) -> DataFrame:
    """Depth, deletions, bases by letter, strands, mapping quality 0 and indels that follow, per position."""
    n = F.count_if
    return els.groupBy(*keys).agg(
        n(~F.col("is_deletion")).alias("depth"),
        n(F.col("is_deletion")).alias("deletions"),
        *(n(F.col("base") == b).alias(f"n_{b.lower()}") for b in "ACGTN"),
        n(~F.col("is_deletion") & ~F.col("is_reverse")).alias("forward"),
        n(~F.col("is_deletion") & F.col("is_reverse")).alias("reverse"),
        n(F.col("map_q") == 0).alias("map_q_zero"),
        n(F.col("next_op") == "I").alias("insertions_follow"),
        n(F.col("next_op") == "D").alias("deletions_follow"),
    )


def consensus(els: DataFrame) -> DataFrame:
    """(contig, position, ref): the most frequent regular base of each position, the first in the alphabet of equals.

    Stands in for a reference sequence where none is given.
    """
    counted = els.where(F.col("base").isin("A", "C", "G", "T")).groupBy(*LOCUS, "base").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*LOCUS).agg(F.min_by("base", F.struct(-F.col("n"), "base")).alias("ref"))


def one_per_fragment(els: DataFrame, drop_discordant: bool = True) -> DataFrame:
    """At most one element per read name and position: mates that agree keep the better base; those that disagree both go, or the better stays."""
    place = W.partitionBy("sample", "contig", "position", "name")
    best = place.orderBy(F.col("qual").desc_nulls_last(), "record_id")
    marked = els.withColumns({"_bases": F.size(F.collect_set(F.coalesce("base", F.lit("-"))).over(place)), "_place": F.row_number().over(best)})
    kept = marked.where("_place = 1 and _bases = 1") if drop_discordant else marked.where("_place = 1")
    return kept.drop("_bases", "_place")


def quality_filtered(els: DataFrame, min_base: int = -1, min_mapping: int = -1) -> DataFrame:
    """A missing quality counts as -1."""
    none = F.lit(-1)
    return els.where((F.coalesce("map_q", none) >= min_mapping) & (F.col("is_deletion") | (F.coalesce("qual", none) >= min_base)))


def strand_tables(els: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """(contig, position, ref, alt, ref_forward, ref_reverse, alt_forward, alt_reverse) at positions where a base differs from the reference; alt is the most frequent such base.

    Without ``refs`` the reference is the consensus, from the same counts.
    """
    counted = els.where(F.col("base").isin("A", "C", "G", "T")).groupBy(*LOCUS, "base").agg(F.count_if(~F.col("is_reverse")).alias("f"), F.count_if("is_reverse").alias("r"))
    per = counted.groupBy(*LOCUS).agg(F.sort_array(F.collect_list(F.struct((-(F.col("f") + F.col("r"))).alias("n"), "base", "f", "r"))).alias("b"))  # four bases at most
    per = per.join(refs, LOCUS) if refs is not None else per.withColumn("ref", F.col("b")[0]["base"])
    own = F.get(F.filter("b", lambda x: x["base"] == F.col("ref")), F.lit(0))
    alt = F.get(F.filter("b", lambda x: x["base"] != F.col("ref")), F.lit(0))
    found = per.select(*LOCUS, "ref", own.alias("o"), alt.alias("a")).where("a is not null")
    zero = F.lit(0).cast("bigint")
    return found.select(*LOCUS, "ref", F.col("a.base").alias("alt"), F.coalesce("o.f", zero).alias("ref_forward"), F.coalesce("o.r", zero).alias("ref_reverse"), F.col("a.f").alias("alt_forward"), F.col("a.r").alias("alt_reverse"))


def quality_sums(els: DataFrame) -> DataFrame:
    """Count and sum of qualities per position and base."""
    return els.where("base is not null").groupBy(*LOCUS, "base").agg(F.count(F.lit(1)).alias("n"), F.sum("qual").alias("qual_sum"))


def indel_alleles(els: DataFrame, min_count: int = 2, min_share: float = 0.25) -> DataFrame:
    """Indels right after a position that enough of its reads show: (contig, position, indel, n, depth)."""
    named = els.withColumn("indel", F.when(F.col("next_op") == "I", F.concat(F.lit("+"), F.upper("inserted"))).when(F.col("next_op") == "D", F.concat(F.lit("-"), F.col("next_len").cast("string"))))
    per = named.groupBy(*LOCUS, "indel").agg(F.count_if(~F.col("is_deletion")).alias("n"))
    total = per.groupBy(*LOCUS).agg(F.sum("n").alias("depth"))
    rows = per.where("indel is not null").join(total, LOCUS)
    return rows.where((F.col("n") >= min_count) & (F.col("n") >= min_share * F.col("depth"))).select(*LOCUS, "indel", "n", "depth")


def pileup_strings(els: DataFrame, min_depth: int = 1, chunk: int = 8192) -> DataFrame:
    """(contig, position, chunk, bases, quals): the elements of a position as text in the order of record ids, the reverse strand in lower case.

    A position deeper than ``chunk`` elements is spread over several rows by a hash of the record, so no row or task grows with its depth.
    """
    depths = els.groupBy(*LOCUS).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_depth)
    letter = F.when(F.col("is_deletion"), "*").when(F.col("is_reverse"), F.lower("base")).otherwise(F.col("base"))
    piece = F.struct("record_id", letter.alias("b"), F.chr(F.coalesce("qual", F.lit(0)) + 33).alias("q"))
    spread = els.join(depths, LOCUS).withColumn("chunk", F.pmod(F.xxhash64("record_id"), F.expr(f"(_n + {chunk - 1}) div {chunk}")).cast("int"))
    packed = spread.groupBy(*LOCUS, "chunk").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return packed.select(*LOCUS, "chunk", F.concat_ws("", F.col("p.b")).alias("bases"), F.concat_ws("", F.col("p.q")).alias("quals"))
