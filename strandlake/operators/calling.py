"""Local assembly and genotyping per active region, base alignment qualities per read, and exact allele frequencies per site.

A region is at most 300 positions long and all its reads count. Its assembly is one group of the distinct sequences with how often each occurs; the pair
HMM runs over blocks of reads, whose genotype likelihoods are summed per event and sample, so a deep region is spread over tasks. Reads meet their
reference by slices, regions their reads by a range join.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import cigar as C
from strandlake.kernels import align, assembly, genotype
from strandlake.kernels import reads as R
from strandlake.operators import intervals, pileup, reference
from strandlake.session import staged

#: Bases around a region, reads of a block, cap of a mapping quality's effect, confidence to emit.
PADDING, BLOCK, MISMAPPING, CONFIDENCE = 100, 256, 45, 30.0
#: Haplotypes that are aligned at once, and pairs of reads and haplotypes that are scored at once, of whatever regions.
_ALIGNED, _PAIRS = 1 << 11, 1 << 13
_FOUND = "contig string, start bigint, stop bigint, ref_start bigint, ref string, n_reads bigint, haplotypes array<struct<score:double,haplotype:string,cigar:string>>"
_SCORED = "contig string, start bigint, position bigint, ref string, alt string, sample string, depth bigint, gl_ref double, gl_het double, gl_hom double"
_HAPLOTYPES = "contig string, start bigint, stop bigint, haplotype string, score double, cigar string, n_reads int"
_CALLS = "contig string, start bigint, position bigint, ref string, alt string, sample string, gt string, depth int, pl string, qual double"


def _stretches(ref: str) -> list[tuple[int, str]]:
    """(offset, sequence) of all stretches without N."""
    return [(m.start(), m.group()) for m in re.finditer("[^N]+", ref)]


def region_groups(found: DataFrame, reads: DataFrame, read_groups: DataFrame, contigs: DataFrame, refs: DataFrame, size: int = reference.SLICE) -> DataFrame:
    """(contig, start, stop, ref_start, ref_seq, record_id, sample, a, b, seq, base_quals, map_q) of the reads that overlap each region.

    The reference of a region and its padding is one or several stretches without N that meet the region; a read is in each that it overlaps.
    """

    @F.pandas_udf("array<struct<at:int,text:string>>")
    def stretches(refs: pd.Series) -> pd.Series:
        return pd.Series([[{"at": at, "text": text} for at, text in _stretches(r)] for r in refs])

    rows = pileup.read_rows(reads, read_groups, contigs, "active_region").where("seq not in ('', '*') and base_quals not in ('', '*') and length(seq) = length(base_quals)")
    rows = rows.select("record_id", "sample", "contig", F.col("contig_position").cast("bigint").alias("a"), (F.col("contig_position") + C.reference_length(F.col("cigar")) - 1).alias("b"), "seq", "base_quals", "map_q")
    keyed = found.withColumn("region", F.concat_ws(":", "contig", "start"))
    with_ref = reference.with_reference(keyed.select("region", "contig", "start", "stop"), refs, "start", "stop", key="region", padding=PADDING, size=size)
    pieces = with_ref.withColumn("_s", F.explode(stretches("ref_seq"))).select("contig", "start", "stop", (F.col("ref_start") + F.col("_s.at")).alias("ref_start"), F.col("_s.text").alias("ref_seq"))
    last = F.col("ref_start") + F.length("ref_seq") - 1
    pieces = pieces.where((F.col("ref_start") <= F.col("stop")) & (last >= F.col("start")))
    joined = intervals.range_join(pieces, rows, ["contig"], "start", "stop", "a", "b", width=1 << 12)
    return joined.where((F.col("a") <= last) & (F.col("b") >= F.col("ref_start")))


def _keyed(rows: DataFrame, keys: list[str], *then: str) -> DataFrame:
    """Rows of equal keys one after the other in one of as many tasks as a shuffle has (their bytes don't tell how long they take)."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, *then)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


_FOUND_ARROW = pa.schema([("contig", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("ref_start", pa.int64()), ("ref", pa.string()), ("n_reads", pa.int64()), ("haplotypes", pa.list_(pa.struct([("score", pa.float64()), ("haplotype", pa.string()), ("cigar", pa.string())])))])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []

    def out() -> pa.RecordBatch:
        ops = iter(align.whole_alignments([(ref, h) for *_, ref, _, found in waiting for _, h in found]))
        return _batch([(*head, [{"score": max(score, -300.0), "haplotype": h, "cigar": align.cigar_text(next(ops))} for score, h in found]) for *head, found in waiting], _FOUND_ARROW)

    n = 0
    for (contig, start, ref_start), rows in groupby(_rows(batches), key=itemgetter(0, 1, 2)):
        counts: Counter[str] = Counter()
        for _, _, _, stop, ref, seq in rows:
            counts[seq] += 1
        found = assembly.assemble(ref, sorted(counts.items()))
        waiting.append((contig, start, stop, ref_start, ref, counts.total(), found))
        n += len(found)
        if n >= _ALIGNED:
            yield out()
            waiting, n = [], 0
    if waiting:
        yield out()


def _regions(groups: DataFrame) -> DataFrame:
    """One row per stretch of a region: its reference, number of reads, and haplotypes with their alignment to the reference."""
    seqs = groups.select("contig", "start", "ref_start", "stop", "ref_seq", F.upper("seq").alias("seq"))
    return _keyed(seqs, ["contig", "start", "ref_start"]).mapInArrow(_assembled, _FOUND)


def assembled(groups: DataFrame) -> DataFrame:
    """Haplotypes of each region, per stretch of its reference, with their alignment to that."""
    return _regions(groups).select("contig", "start", "stop", F.inline("haplotypes"), F.col("n_reads").cast("int").alias("n_reads")).select("contig", "start", "stop", "haplotype", "score", "cigar", "n_reads")


def _events(haplotypes: list[dict], ref: str, ref_start: int) -> list[set[tuple[int, str, str]]]:
    return [set(assembly.haplotype_events(R.parse(h["cigar"]), ref, h["haplotype"], ref_start)) for h in haplotypes]


_READ = ["sample", "seq", "base_quals", "map_q"]
_REGION = ["stop", "ref", "haplotypes"]
_SCORED_ARROW = pa.schema([("contig", pa.string()), ("start", pa.int64()), ("position", pa.int64()), ("ref", pa.string()), ("alt", pa.string()), ("sample", pa.string()), ("depth", pa.int64()), *((c, pa.float64()) for c in ("gl_ref", "gl_het", "gl_hom"))])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Genotype likelihoods of each event of a region in a block of its reads: one row per event and sample. A block's first row is its region."""
    waiting: list[tuple] = []

    def out() -> Iterator[pa.RecordBatch]:
        rows = []
        scored = align.pair_hmm_matrices([(seqs, quals, texts) for *_, seqs, quals, texts in waiting])
        for (contig, start, sites, events, samples, *_), scores in zip(waiting, scored, strict=True):
            scores = np.maximum(scores, scores.max(axis=1, keepdims=True) - MISMAPPING / 10)
            names = sorted(set(samples))
            of = [np.flatnonzero(samples == s) for s in names]
            done: dict[bytes, list[np.ndarray]] = {}
            for event in sites:
                carries = np.array([event in ev for ev in events])
                if carries.all():
                    continue
                if (key := carries.tobytes()) not in done:  # events of the same haplotypes
                    by_allele = np.stack([scores[:, ~carries].max(axis=1), scores[:, carries].max(axis=1)], axis=1)
                    done[key] = [genotype.likelihoods(by_allele[at]) for at in of]
                rows += [(contig, start, *event, s, len(at), *gl.tolist()) for s, at, gl in zip(names, of, done[key], strict=True)]
        if rows:
            yield _batch(rows, _SCORED_ARROW)

    pairs = 0
    for (contig, start, ref_start, _), rows in groupby(_rows(batches), key=itemgetter(0, 1, 2, 3)):
        *_, stop, ref, haplotypes = next(rows)
        reads = [(sample or "", seq.upper(), quals, 60 if map_q is None else max(6, int(map_q))) for _, _, _, _, _, sample, seq, quals, map_q, *_ in rows]
        events = _events(haplotypes, ref, ref_start)
        sites = sorted({e for ev in events for e in ev if start <= e[0] <= stop})
        if not reads or not sites:
            continue
        quals = [[max(6, min(ord(x) - 33, cap)) for x in q] for _, _, q, cap in reads]
        texts = [h["haplotype"] for h in haplotypes]
        waiting.append((contig, start, sites, events, np.array([s for s, *_ in reads], object), [seq for _, seq, _, _ in reads], quals, texts))
        pairs += len(reads) * len(texts)
        if pairs >= _PAIRS:
            yield from out()
            waiting, pairs = [], 0
    if waiting:
        yield from out()


_CALLS_ARROW = pa.schema([("contig", pa.string()), ("start", pa.int64()), ("position", pa.int64()), ("ref", pa.string()), ("alt", pa.string()), ("sample", pa.string()), ("gt", pa.string()), ("depth", pa.int32()), ("pl", pa.string()), ("qual", pa.float64())])


def _genotyped(confidence: float):
    """Sites with the likelihoods of all their samples as calls of those that are confident."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            samples = batch.column("samples")
            of, each = np.repeat(np.arange(batch.num_rows), samples.value_lengths().to_numpy(zero_copy_only=False)), samples.flatten()
            gls = np.stack([each.field(c).to_numpy(zero_copy_only=False) for c in ("gl_ref", "gl_het", "gl_hom")], axis=1)
            qual, count = genotype.site_qualities(of, gls)
            at = np.flatnonzero(((count > 0) & (qual >= confidence))[of])
            if not len(at):
                continue
            pl = np.rint(np.minimum(-10 * (gls[at] - gls[at].max(axis=1, keepdims=True)), 2**31 - 1)).astype(np.int64)
            names = ["/".join(map(str, g)) for g in genotype.genotypes(2)]
            sites = batch.select(["contig", "start", "position", "ref", "alt"]).take(pa.array(of[at]))
            each = each.take(pa.array(at))
            sample = pa.array([s or None for s in each.field("sample").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*sites.columns, sample, pa.array([names[g] for g in gls[at].argmax(axis=1)]), each.field("depth").cast(pa.int32()), pa.array([",".join(map(str, x)) for x in pl.tolist()]), pa.array([round(x, 2) for x in qual[of[at]].tolist()])], schema=_CALLS_ARROW)

    return run


def called(groups: DataFrame, confidence: float = CONFIDENCE, block: int = BLOCK) -> DataFrame:
    """Genotypes of the events that haplotypes show inside the region: one row per event and sample with reads.

    Reads are scored against all haplotypes by the pair HMM, an allele of an event by the best haplotype that carries it; genotypes come from
    reads' alleles, QUAL from the exact posterior over all samples. A region's reads are scored in blocks of about ``block``.
    """
    groups = staged(groups, "region-groups")
    return called_of(groups, staged(_regions(groups), "haplotypes"), confidence, block)


def called_of(groups: DataFrame, found: DataFrame, confidence: float = CONFIDENCE, block: int = BLOCK) -> DataFrame:
    """``called`` of groups and their ``region_haplotypes``, which are read several times."""
    found = found.where(F.size("haplotypes") > 1)
    blocks = F.expr(f"(n_reads + {block - 1}) div {block}")
    key = ["contig", "start", "ref_start"]
    reads = groups.join(found.select(*key, blocks.alias("_blocks")), key).withColumn("_block", F.pmod(F.xxhash64("record_id"), F.col("_blocks")))
    none = lambda rows, names: [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names]
    copies = found.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).select(*key, "_block", F.lit(0).alias("_kind"), *none(groups, _READ), *_REGION)
    rows = copies.unionByName(reads.select(*key, "_block", F.lit(1).alias("_kind"), *_READ, *none(found, _REGION)))
    parts = _keyed(rows, [*key, "_block"], "_kind").mapInArrow(_scored, _SCORED)
    site = ["contig", "start", "position", "ref", "alt"]
    per = parts.groupBy(*site, "sample").agg(F.sum("depth").alias("depth"), *(F.sum(c).alias(c) for c in ("gl_ref", "gl_het", "gl_hom")))
    packed = per.groupBy(*site).agg(F.sort_array(F.collect_list(F.struct("sample", "depth", "gl_ref", "gl_het", "gl_hom"))).alias("samples"))  # a row per sample
    return packed.mapInArrow(_genotyped(confidence), _CALLS)


_PHASED = "contig string, start bigint, position bigint, ref string, alt string, sample string, phase_set int, phased_gt string"
_PHASED_ARROW = pa.schema([("contig", pa.string()), ("start", pa.int64()), ("position", pa.int64()), ("ref", pa.string()), ("alt", pa.string()), ("sample", pa.string()), ("phase_set", pa.int32()), ("phased_gt", pa.string())])


def phased(calls: DataFrame, found: DataFrame) -> DataFrame:
    """Heterozygous calls of ``called`` that the haplotypes of their region hold together or apart: (contig, start, position, ref, alt, sample, phase_set, phased_gt).

    found: ``region_haplotypes``. A region's calls and haplotypes are one group: at most a few events for each sample, and 128 haplotypes a graph.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (contig, start), rows in groupby(_rows(batches), key=itemgetter(0, 1)):
            events, hets = [], {}
            for _, _, _, position, ref, alt, sample, gt, ref_start, piece, haplotypes in rows:
                if haplotypes is not None:
                    events += _events(haplotypes, piece, ref_start)
                elif gt == "0/1":
                    hets.setdefault(sample, []).append((position, ref, alt))
            for sample, own in hets.items() if events else ():
                out += [(contig, start, *event, sample, number, gt) for event, (number, gt) in genotype.phase_sets(events, sorted(own)).items()]
            if len(out) >= _PAIRS:
                yield _batch(out, _PHASED_ARROW)
                out = []
        if out:
            yield _batch(out, _PHASED_ARROW)

    key = ["contig", "start"]
    none = lambda rows, names: [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names]
    call, piece = ["position", "ref", "alt", "sample", "gt"], ["ref_start", "piece", "haplotypes"]
    found = found.withColumnRenamed("ref", "piece")
    rows = found.select(*key, F.lit(0).alias("_kind"), *none(calls, call), *piece).unionByName(calls.select(*key, F.lit(1).alias("_kind"), *call, *none(found, piece)))
    return _keyed(rows, key, "_kind", "ref_start").mapInArrow(run, _PHASED)


def region_haplotypes(groups: DataFrame) -> DataFrame:
    """(contig, start, stop, ref_start, ref, n_reads, haplotypes) of each stretch of a region."""
    return _regions(groups)


def with_alignment_quality(reads: DataFrame, refs: DataFrame, band: int = 7) -> DataFrame:
    """Add ``baq``: capped base qualities as text for reads with an indel or a clip in their CIGAR; others keep theirs.

    reads: placed rows with record_id, contig, contig_position, cigar, seq, base_quals.
    """

    @F.pandas_udf("string")
    def capped(seq: pd.Series, quals: pd.Series, ref: pd.Series, lead: pd.Series) -> pd.Series:
        out = []
        for s, q, r, at in zip(seq, quals, ref, lead, strict=True):
            if s is None or q is None or r is None or len(s) != len(q):
                out.append(q)
                continue
            values = align.base_alignment_quality(s.upper(), [ord(x) - 33 for x in q], r, band - int(at), band)
            out.append("".join(chr(33 + v) for v in values))
        return pd.Series(out)

    soft = F.coalesce(F.regexp_extract("cigar", r"^(?:\d+H)?(\d+)S", 1).try_cast("int"), F.lit(0))
    needed = F.col("cigar").rlike("[IDS]") & ~F.col("cigar").contains("N")
    ends = reads.withColumn("_end", F.col("contig_position") + C.reference_length(F.col("cigar")) - 1)
    some = reference.with_reference(ends.where(needed & (F.col("contig_position") > band)), refs, "contig_position", "_end", padding=band)
    done = some.withColumn("baq", capped("seq", "base_quals", "ref_seq", soft)).select("record_id", "baq")
    return reads.join(done, "record_id", "left").withColumn("baq", F.coalesce("baq", "base_quals"))


def allele_frequencies(calls: DataFrame) -> DataFrame:
    """(contig, contig_position, ref_allele, alt, qual, alt_count, n_samples) by the exact posterior, from biallelic diploid PLs, one record per sample and alternate.

    calls: contig, contig_position, ref_allele, alt, sample_name, pl_ref, pl_het, pl_hom. An alternate's group has a row per sample, however many records it has.
    """
    keys = ["contig", "contig_position", "ref_allele", "alt"]
    one = calls.where("pl_ref is not null and pl_het is not null and pl_hom is not null").groupBy(*keys, "sample_name").agg(F.min(F.struct("pl_ref", "pl_het", "pl_hom")).alias("p"))
    packed = one.groupBy(*keys).agg(F.sort_array(F.collect_list("p")).alias("p"))

    @F.pandas_udf("struct<qual:double,alt_count:int>")
    def exact(pls: pd.Series) -> pd.DataFrame:
        rows = [genotype.site_quality([np.array([x["pl_ref"], x["pl_het"], x["pl_hom"]]) / -10.0 for x in site]) for site in pls]
        return pd.DataFrame(rows, columns=["qual", "alt_count"])

    return packed.select(*keys, exact("p").alias("r"), F.size("p").alias("n_samples")).select(*keys, "r.qual", "r.alt_count", "n_samples")
