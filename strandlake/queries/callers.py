"""Queries on local assembly, genotyping, alignment kernels and allele frequencies: dynamic programmes, so without SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import cigar as C
from strandlake.kernels import align
from strandlake.operators import annotations, calling, pileup, reference, regions, variants
from strandlake.queries.pileups import _consensus
from strandlake.queries.somatics import active_regions
from strandlake.session import staged
from strandlake.tables import table


#: Bases of a slice of the consensus: reads lie apart, so most of a longer one would be N.
_SLICE = 256


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    tables = [table(spark, sf, n) for n in ("reads", "read_groups", "contigs")]
    refs = reference.read_slices(pileup.read_rows(*tables), _SLICE)
    return calling.region_groups(staged(active_regions(spark, sf), "regions"), *tables, refs, size=_SLICE)


def assembly_haplotypes(spark: SparkSession, sf: str) -> DataFrame:
    return calling.assembled(_groups(spark, sf))


def region_calls(spark: SparkSession, sf: str) -> DataFrame:
    return calling.called(_groups(spark, sf))


def phased_calls(spark: SparkSession, sf: str) -> DataFrame:
    groups = staged(_groups(spark, sf), "region-groups")
    found = staged(calling.region_haplotypes(groups), "haplotypes")
    return calling.phased(calling.called_of(groups, found), found)


def trimmed_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Active regions shrunk to the events called in them."""
    groups = staged(_groups(spark, sf), "region-groups")
    events = staged(calling.called(groups), "calls").select("contig", "start", "position", "ref", "alt").distinct()
    got = regions.trimmed(groups.select("contig", "start", "stop").distinct(), events)
    return got.select("contig", "start", "stop", "from_position", "to_position", "n_events", F.col("left_flank.to_position").alias("left_to"), F.col("right_flank.from_position").alias("right_from"))


def alignment_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Reads whose base qualities the alignment caps, and by how much in all."""
    refs = reference.slices(_consensus(spark, sf))
    rows = pileup.read_rows(*(table(spark, sf, n) for n in ("reads", "read_groups", "contigs"))).where("base_quals not in ('', '*') and seq not in ('', '*')")
    capped = calling.with_alignment_quality(rows.select("record_id", "contig", "contig_position", "cigar", "seq", "base_quals"), refs)
    return capped.where("baq <> base_quals").select("record_id", "baq")


def af_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Every alternate of every site against the reference allele."""
    calls = variants.biallelic(annotations.genotypes(variants.decoded(table(spark, sf, "variants")))).where("contig is not null")
    return calling.allele_frequencies(calls)


def sw_align(spark: SparkSession, sf: str) -> DataFrame:
    """Reads with an indel, aligned anew to the consensus that they cover."""

    @F.pandas_udf("struct<start:int,cigar:string,score:bigint>")
    def aligned(ref: pd.Series, seq: pd.Series) -> pd.DataFrame:
        found = [align.smith_waterman(r, s.upper(), align.REALIGN_COSTS) for r, s in zip(ref, seq, strict=True)]
        return pd.DataFrame([(o, align.cigar_text(ops), score) for o, ops, score in found], columns=["start", "cigar", "score"])

    refs = reference.slices(_consensus(spark, sf))
    rows = pileup.read_rows(*(table(spark, sf, n) for n in ("reads", "read_groups", "contigs"))).where("seq not in ('', '*') and cigar rlike '[ID]' and not cigar like '%N%'")
    rows = rows.select("record_id", "contig", "contig_position", "seq", (F.col("contig_position") + C.reference_length(F.col("cigar")) - 1).alias("end"))
    with_ref = reference.with_reference(rows, refs, "contig_position", "end", padding=10)
    return with_ref.withColumn("a", aligned("ref_seq", "seq")).select("record_id", (F.col("ref_start") + F.col("a.start")).alias("position"), "a.cigar", "a.score")


QUERIES = {f.__name__: f for f in (assembly_haplotypes, region_calls, phased_calls, trimmed_regions, alignment_quality, af_exact, sw_align)}
ORACLES: dict[str, str] = {}
