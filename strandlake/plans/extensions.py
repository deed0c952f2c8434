"""Named extension points: a user's own filters, changes of reads, annotations, covariates, samplers, calculators and formats beside those of the engine.

An extension is a function of DataFrames or Columns, so what it does is part of the plan; only ``map_loci``, ``map_reads`` and ``process_bins`` call Python,
in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.kernels import align, genotype
from strandlake.operators import annotations, bins, contexts, filters, pileup, readchecks, regions, tallies
from strandlake.sources import fastq, reports, sinks, text
from strandlake.tables import with_sample

#: What can be registered, and what a function of that kind gets and gives.
KINDS = {
    "read_filter": "() -> Column, true where a read goes",
    "read_transformer": "(reads) -> reads; option place: first, any or last",
    "info_annotation": "(Sites) -> rows by contig and position",
    "format_annotation": "(Sites) -> rows by sample, contig and position",
    "covariate": "(seq, quals, reverse) -> a value for each base",
    "downsampler": "(elements, depth) -> elements",
    "frequency_calculator": "(likelihoods by sample) -> log10 posterior of the alternates' number",
    "pair_hmm": "(reads, quals, haplotypes) -> log10 likelihoods, reads by haplotypes",
    "loader": "(spark, path, **tables) -> DataFrame",
    "writer": "(df, path, **tables) -> None",
}


STRAND_COLUMNS = [f"{a}_{d}" for a in ("ref", "alt") for d in ("forward", "reverse")]


def samples_of(rows: DataFrame) -> DataFrame:
    """The FORMAT annotations SB, DP and MQ0 at the sites of placed reads (``pileup.read_rows``), made together; null where a sample has no such read."""
    found = annotations.sample_tables(rows)
    return found.select("sample", *pileup.LOCUS, F.array(*STRAND_COLUMNS).alias("SB"), F.nullif("depth", F.lit(0)).alias("DP"), F.nullif("mq0", F.lit(0)).alias("MQ0"))


class ExtensionError(ValueError):
    pass


@dataclass
class Registry:
    held: dict[str, dict[str, tuple[Callable, dict[str, Any]]]] = field(default_factory=lambda: {k: {} for k in KINDS})

    def register(self, kind: str, name: str, function: Callable, **options: Any) -> Callable:
        if kind not in self.held:
            raise ExtensionError(f"no such kind: {kind}; there are {', '.join(KINDS)}")
        if name in self.held[kind]:
            raise ExtensionError(f"{kind} {name!r} is already there")
        self.held[kind][name] = (function, options)
        return function

    def get(self, kind: str, name: str) -> Callable:
        return self.entry(kind, name)[0]

    def entry(self, kind: str, name: str) -> tuple[Callable, dict[str, Any]]:
        if name not in self.held.get(kind, {}):
            raise ExtensionError(f"no {kind} {name!r}; there are {', '.join(self.names(kind)) or 'none'}")
        return self.held[kind][name]

    def names(self, kind: str) -> list[str]:
        return sorted(self.held.get(kind, {}))

    def filtered(self, reads: DataFrame, names: list[str]) -> DataFrame:
        """Reads that none of the named filters takes; one filter of the plan, whose parts are pushed down."""
        conditions = [F.coalesce(self.get("read_filter", n)(), F.lit(False)) for n in names]
        return reads.where(~reduce(lambda a, b: a | b, conditions)) if conditions else reads

    def transformed(self, reads: DataFrame, names: list[str]) -> DataFrame:
        entries = [self.entry("read_transformer", n) for n in names]
        return readchecks.transformed(reads, [(f, options.get("place", "any")) for f, options in entries])

    def covariates(self, names: list[str]) -> dict[str, Callable]:
        """For ``recal.counted(more=...)``."""
        return {n: self.get("covariate", n) for n in names}

    def annotated(self, sites: Sites, info: list[str] = (), per_sample: list[str] = ()) -> tuple[DataFrame, DataFrame | None]:
        """(sites with the INFO annotations, rows per sample with the FORMAT ones). All are joined by the site, so their shuffles share one partitioning."""
        out = sites.sites
        for name in info:
            out = out.join(self.get("info_annotation", name)(sites), pileup.LOCUS, "left")
        made = [n for n in per_sample if sites.samples is not None and n in sites.samples.columns]
        samples = sites.samples.select("sample", *pileup.LOCUS, *made) if made else None
        for name in [n for n in per_sample if n not in made]:
            rows = self.get("format_annotation", name)(sites)
            samples = rows if samples is None else _joined_by_sample(samples, rows)
        return out, samples


def _joined_by_sample(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join by sample and site; a null sample is one like any other."""
    keys = ["sample", *pileup.LOCUS]
    other = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    joined = a.join(other, [a[k].eqNullSafe(other[f"_{k}"]) for k in keys], "full_outer")
    # Sites are never null, so a null position tells the side that is missing.
    mine = F.col("position").isNotNull()
    return joined.withColumns({k: F.when(mine, F.col(k)).otherwise(F.col(f"_{k}")) for k in keys}).drop(*(f"_{k}" for k in keys))


@dataclass(frozen=True)
class Sites:
    """What annotations see: the sites (contig, position, ref, alt), pileup elements, counts per position, and the reads' strand tables.

    samples: rows by sample, contig and position with FORMAT annotations that are made already, as columns of their names.
    """

    sites: DataFrame
    elements: DataFrame
    counts: DataFrame
    samples: DataFrame | None = None

    def at_sites(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.sites.select(*pileup.LOCUS).distinct(), pileup.LOCUS, "left_semi")


def _rank_sum(name: str) -> Callable[[Sites], DataFrame]:
    return lambda s: annotations.rank_sums(s.elements, s.sites.select(*pileup.LOCUS, "ref", "alt")).where(F.col("statistic") == name).select(*pileup.LOCUS, F.col("z").alias(name))


def standard() -> Registry:
    """The engine's own extensions."""
    r = Registry()
    for name, condition in filters.FILTERS.items():
        r.register("read_filter", name, condition)
    r.register("read_transformer", "reencode", lambda reads: readchecks.checked_encoding(reads, fix=True), place="first")
    r.register("read_transformer", "check_encoding", readchecks.checked_encoding, place="first")
    strands = lambda s: annotations.with_strand_bias(tallies.strand_tables(s.at_sites(s.counts), s.sites.select(*pileup.LOCUS, "ref")), 0)
    r.register("info_annotation", "DP", lambda s: tallies.base_counts(s.at_sites(s.counts)).select(*pileup.LOCUS, F.col("depth").alias("DP")))
    r.register("info_annotation", "BaseCounts", lambda s: tallies.base_counts(s.at_sites(s.counts)).select(*pileup.LOCUS, F.array("n_a", "n_c", "n_g", "n_t").alias("BaseCounts")))
    r.register("info_annotation", "MQ", lambda s: annotations.mapping_quality(s.at_sites(s.elements)).select(*pileup.LOCUS, F.col("mq").alias("MQ"), F.col("mq0").alias("MQ0")))
    r.register("info_annotation", "SOR", lambda s: strands(s).select(*pileup.LOCUS, F.col("sor").alias("SOR")))
    r.register("info_annotation", "FS", lambda s: strands(s).select(*pileup.LOCUS, F.col("fs").alias("FS")))
    for name in ("BaseQRankSum", "MQRankSum", "ReadPosRankSum"):
        r.register("info_annotation", name, _rank_sum(name))
    strand_columns = STRAND_COLUMNS
    r.register("format_annotation", "SB", lambda s: annotations.strand_bias_by_sample(s.elements, s.sites).select("sample", *pileup.LOCUS, F.array(*strand_columns).alias("SB")))
    r.register("format_annotation", "DP", lambda s: s.at_sites(s.elements).where("not is_deletion").groupBy("sample", *pileup.LOCUS).agg(F.count(F.lit(1)).alias("DP")))
    r.register("format_annotation", "MQ0", lambda s: s.at_sites(annotations.mapping_quality_zero_by_sample(s.elements)).withColumnRenamed("mq0", "MQ0"))
    r.register("downsampler", "by_locus", contexts.downsampled)
    r.register("downsampler", "by_start", lambda reads, depth: regions.capped_by_start(reads, ["contig_name", "contig_position"], depth))
    r.register("frequency_calculator", "exact", genotype.allele_count_posterior)
    r.register("frequency_calculator", "linear", genotype.linear_posterior)
    r.register("frequency_calculator", "pooled", genotype.pooled_posterior)
    r.register("pair_hmm", "log10", align.pair_hmm_matrix)
    r.register("loader", "sam", text.read_sam)
    r.register("loader", "vcf", text.read_vcf)
    r.register("loader", "intervals", text.read_intervals)
    r.register("loader", "dictionary", text.read_dictionary)
    r.register("loader", "report", reports.read_report)
    r.register("loader", "fastq", lambda spark, path: (fastq.register(spark), spark.read.format("strand_fastq").load(path))[1])
    r.register("writer", "sam", lambda df, path, contigs, read_groups: sinks.write_sorted(df, contigs, sinks.sam_line(), sinks.sam_header_lines(contigs, read_groups), path))
    r.register("writer", "vcf", lambda df, path, contigs: sinks.write_sorted(df, contigs, sinks.vcf_line(), sinks.vcf_header_lines(contigs, ["sample"]), path))
    r.register("writer", "fastq_pairs", sinks.write_fastq_pairs)
    return r


def map_reads(reads: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function over batches of reads; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return reads.mapInPandas(run, schema)


def map_loci(rows: DataFrame, function: Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keys: tuple[str, ...] = tuple(pileup.LOCUS)) -> DataFrame:
    """A function over the rows of each locus (elements, or features of tracks), which gets them as a stream of batches: a deep locus is never in memory as a whole."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(tuple(k.as_py() for k in key), batches)

    return rows.groupBy(*keys).applyInArrow(run, schema)


def process_bins(tables: dict[str, DataFrame], contigs: DataFrame, function: Callable[[int, dict[str, pd.DataFrame]], pd.DataFrame], schema: str, length: int = bins.BIN_LENGTH, position: str = "contig_position") -> DataFrame:
    """A function over two tables bin by bin, as a stage of a plan: it gets the bin's number and the rows of both that begin in it.

    A bin is one call, so ``length`` bounds what one holds; ``bins.skewed_bins`` tells which bins are deep.
    """
    if len(tables) != 2:
        raise ExtensionError("two tables meet in a bin")
    (a_name, a), (b_name, b) = tables.items()
    placed = [bins.with_bin(t, contigs, position, length=length).where("bin_id is not null") for t in (a, b)]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        number = int((left if len(left) else right)["bin_id"].iloc[0])
        return function(number, {a_name: left, b_name: right})

    return placed[0].groupBy("bin_id").cogroup(placed[1].groupBy("bin_id")).applyInPandas(run, schema)


def sample_of(reads: DataFrame, read_groups: DataFrame) -> DataFrame:
    """Reads with ``sample``, as functions of loci and bins may need it."""
    return with_sample(reads, read_groups)


__all__ = ["KINDS", "ExtensionError", "Registry", "Sites", "map_loci", "map_reads", "process_bins", "sample_of", "samples_of", "standard"]
