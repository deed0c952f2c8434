"""Cutting of reads and mending of overlapping mates: per read and per pair."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake import tables as t
from strandlake.functions import cigar as C
from strandlake.kernels import reads as R
from strandlake.operators import pileup

#: Fixed value: qualities up to this are cut from the ends.
LOW_ENDS = 9
_CUT = "struct<start:bigint,cigar:string,seq:string,base_quals:string>"


def finalized(rows: DataFrame, low: int = LOW_ENDS, keep_soft_clips: bool = False) -> DataFrame:
    """Placed reads cut for calling: low-quality ends, then soft clips dropped (or turned into aligned bases), then what lies beyond the adaptor.

    Adds ``cut``; a read of which nothing is left has an empty sequence there. Reads whose sequence and qualities differ in length are left as they are.
    """

    @F.pandas_udf(_CUT)
    def run(start: pd.Series, cigar: pd.Series, seq: pd.Series, quals: pd.Series, flag: pd.Series, mate: pd.Series, insert: pd.Series) -> pd.DataFrame:
        out = []
        for a, c, s, q, f, m, i in zip(start, cigar, seq, quals, flag, mate, insert, strict=True):
            if s is None or q is None or len(s) != len(q) or R.read_length(R.parse(c)) != len(s):
                out.append((a, c, s, q))
                continue
            f = int(f)
            read = R.clipped_ends(R.Read.of(int(a), c, s, q), low)
            if read.seq:
                read = R.reverted_soft_clips(read) if keep_soft_clips else R.without_soft_clips(read)
            paired = bool(f & t.FLAG_PAIRED) and not f & (t.FLAG_MATE_UNMAPPED | t.FLAG_UNMAPPED) and bool(f & t.FLAG_REVERSE) != bool(f & t.FLAG_MATE_REVERSE)
            size = None if pd.isna(i) else int(i)
            edge = R.adaptor_boundary(read.start, read.end, None if pd.isna(m) else int(m), size, bool(f & t.FLAG_REVERSE), paired)
            if read.seq:
                read = R.without_adaptor(read, edge, bool(f & t.FLAG_REVERSE))
            out.append((read.start, read.cigar if read.seq else "*", read.seq, read.quals))
        return pd.DataFrame(out, columns=["start", "cigar", "seq", "base_quals"])

    return rows.withColumn("cut", run("contig_position", "cigar", "seq", "base_quals", "flag", "mate_position", "inferred_size"))


def _overlapping_pairs(rows: DataFrame) -> DataFrame:
    """Mates side by side (columns ending in 1 and 2) whose reference spans overlap; of several deliveries of a mate the smallest id."""
    sound = rows.where((F.length("seq") == F.length("base_quals")) & (C.read_length(F.col("cigar")) == F.length("seq")) & (F.col("flag").bitwiseAND(t.FLAG_PAIRED) != 0))
    fields = ["record_id", "contig_position", "cigar", "seq", "base_quals"]

    def side(bit: int, mark: str) -> DataFrame:
        one = sound.where(F.col("flag").bitwiseAND(bit) != 0).groupBy("sample", "contig", F.regexp_replace("read_name", "/[12]$", "").alias("name")).agg(F.min_by(F.struct(*fields), "record_id").alias("r"))
        return one.select("sample", "contig", "name", *(F.col(f"r.{c}").alias(f"{c}{mark}") for c in fields))

    a, b = side(t.FLAG_FIRST, "1"), side(t.FLAG_SECOND, "2")
    pairs = a.join(b, a["sample"].eqNullSafe(b["sample"]) & (a["contig"] == b["contig"]) & (a["name"] == b["name"]))
    end = lambda m: F.col(f"contig_position{m}") + C.reference_length(F.col(f"cigar{m}")) - 1
    return pairs.where((F.col("contig_position1") <= end("2")) & (F.col("contig_position2") <= end("1"))).select(a["*"], *(b[f"{c}2"] for c in fields))


def mended_mates(rows: DataFrame, cap: int = 20) -> DataFrame:
    """(record_id, base_quals) of mates that overlap their other mate: agreeing bases capped, differing ones 0.

    A fragment's mates are its first and its second read; of several deliveries of one the smallest id, so a name joins one row with one.
    """

    @F.pandas_udf("struct<a:string,b:string>")
    def run(a1: pd.Series, c1: pd.Series, s1: pd.Series, q1: pd.Series, a2: pd.Series, c2: pd.Series, s2: pd.Series, q2: pd.Series) -> pd.DataFrame:
        out = [R.mended_mates(R.Read.of(int(a), b, c, d), R.Read.of(int(e), f, g, h), cap) for a, b, c, d, e, f, g, h in zip(a1, c1, s1, q1, a2, c2, s2, q2, strict=True)]
        return pd.DataFrame(out, columns=["a", "b"])

    pairs = _overlapping_pairs(rows)
    fields = ["contig_position", "cigar", "seq", "base_quals"]
    mended = pairs.withColumn("q", run(*(f"{c}{m}" for m in "12" for c in fields)))
    return mended.select(F.inline(F.array(F.struct(F.col("record_id1").alias("record_id"), F.col("q.a").alias("base_quals")), F.struct(F.col("record_id2").alias("record_id"), F.col("q.b").alias("base_quals")))))


def ready_for_calling(reads: DataFrame, read_groups: DataFrame, contigs: DataFrame, low: int = LOW_ENDS) -> DataFrame:
    """Reads as assembly and likelihoods take them: overlapping mates mended, then cut as ``finalized`` does; reads of which nothing is left go.

    Reads without CIGAR, sequence or qualities stay as they are.
    """
    placed = pileup.read_rows(reads, read_groups, contigs, "active_region").where("seq not in ('', '*') and base_quals not in ('', '*')")
    mended = mended_mates(placed).groupBy(F.col("record_id").alias("_id")).agg(F.min("base_quals").alias("_mended"))
    sound = F.coalesce(F.expr("cigar not in ('', '*') and seq not in ('', '*') and base_quals not in ('', '*') and contig_position >= 1"), F.lit(False))
    joined = reads.where(sound).join(mended, F.col("record_id") == F.col("_id"), "left").withColumn("base_quals", F.coalesce("_mended", "base_quals")).drop("_id", "_mended")  # no other read is mended
    cut = finalized(joined, low).where("length(cut.seq) > 0")
    cut = cut.withColumns({"contig_position": F.col("cut.start").cast("int"), "cigar": F.col("cut.cigar"), "seq": F.col("cut.seq"), "base_quals": F.col("cut.base_quals")}).select(*reads.columns)
    return cut.unionByName(reads.where(~sound))


_MERGED = "struct<start:bigint,cigar:string,seq:string,base_quals:string>"


def merged_mates(rows: DataFrame) -> DataFrame:
    """(sample, contig, name, record_id1, record_id2, start, cigar, seq, base_quals): gapless mates that overlap as one read over both; pairs with an indel, a clip or no overlap don't come out.

    rows: as for ``mended_mates``, with upper case sequences.
    """

    @F.pandas_udf(_MERGED)
    def run(a1: pd.Series, c1: pd.Series, s1: pd.Series, q1: pd.Series, a2: pd.Series, c2: pd.Series, s2: pd.Series, q2: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c, d, e, f, g, h in zip(a1, c1, s1, q1, a2, c2, s2, q2, strict=True):
            one = R.merged_mates(R.Read.of(int(a), b, c, d), R.Read.of(int(e), f, g, h))
            out.append((one.start, one.cigar, one.seq, one.quals) if one else (None, None, None, None))
        return pd.DataFrame(out, columns=["start", "cigar", "seq", "base_quals"]).astype({"start": "Int64"})

    pairs = _overlapping_pairs(rows)
    fields = ["contig_position", "cigar", "seq", "base_quals"]
    merged = pairs.withColumn("_m", run(*(f"{c}{m}" for m in "12" for c in fields))).where("_m.seq is not null")
    return merged.select("sample", "contig", "name", "record_id1", "record_id2", "_m.*")
