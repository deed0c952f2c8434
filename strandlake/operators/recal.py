"""Recalibration of base qualities: covariates per base, error counts, empirical qualities and their application.

A read meets the reference and the known sites in one equi-join: both are held in slices that overlap by ``MARGIN``, so a read no longer than that lies in the
slice of its start; longer ones take the way over all slices they touch. Covariates are then counted with numpy per batch of reads, so no row per
base exists; what is shuffled is counts by (read group, quality, context, cycle), whose number is bounded by the covariates' values. Every table is
rolled up from their sums.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions import cigar as C
from strandlake.kernels import columns as K2
from strandlake.kernels import recalibrate as K
from strandlake.operators import pileup, reference
from strandlake.session import staged
from strandlake.tables import FLAG_PAIRED, FLAG_REVERSE, FLAG_SECOND, contig_key

#: Bases of the context, largest cycle, qualities below which bases aren't used, and what ends are masked as low.
CONTEXT, MAX_CYCLE, MIN_QUALITY, LOW_TAIL, LEVELS = 2, 500, 6, 2, 16
#: Reference bases that slices overlap by.
MARGIN = 512
_SITE_BIN = 1024


def known_sites(variants: DataFrame) -> DataFrame:
    """(contig, position) of every position a known variant covers."""
    last = F.col("contig_position") + F.greatest(F.length("ref_allele"), F.lit(1)) - 1
    rows = variants.select(contig_key(F.col("contig_name")).alias("contig"), F.explode(F.sequence(F.col("contig_position"), last)).alias("position"))
    return rows.where("contig is not null").distinct()


def with_known_positions(reads: DataFrame, sites: DataFrame) -> DataFrame:
    """Add ``known``: the known positions that the read covers (no more than it is long)."""
    end = F.col("contig_position") + C.reference_length(F.col("cigar")) - 1
    spans = reads.select("record_id", contig_key(F.col("contig")).alias("contig"), F.col("contig_position").alias("_lo"), end.alias("_hi"))
    spans = spans.where("_hi >= _lo").withColumn("_bin", F.explode(F.sequence(F.expr(f"_lo div {_SITE_BIN}"), F.expr(f"_hi div {_SITE_BIN}"))))
    binned = sites.select("contig", F.col("position").cast("bigint").alias("_site"), F.expr(f"position div {_SITE_BIN}").alias("_bin"))
    found = spans.join(binned, ["contig", "_bin"]).where("_site between _lo and _hi").groupBy("record_id").agg(F.collect_set("_site").alias("known"))
    return reads.join(found, "record_id", "left")


def reads_on_reference(reads: DataFrame, read_groups: DataFrame, contigs: DataFrame, refs: DataFrame, sites: DataFrame, margin: int = MARGIN, size: int = reference.SLICE) -> DataFrame:
    """(record_id, read_group, is_reverse, is_second, contig_position, cigar, seq, base_quals, ref_seq, known) of the reads whose bases can count.

    refs: slices of the reference (reference.py). ref_seq is what the read covers, known the known positions in it.
    """
    rows = pileup.read_rows(reads, read_groups, contigs, "recalibrator").where("seq not in ('', '*') and base_quals is not null and base_quals not in ('', '*') and read_group is not null")
    flag = lambda bit: F.col("flag").bitwiseAND(bit) != 0
    kept = ["record_id", "read_group", "is_reverse", "is_second", "contig_position", "cigar", "seq", "base_quals"]
    rows = rows.withColumns({"is_reverse": flag(FLAG_REVERSE), "is_second": flag(FLAG_PAIRED) & flag(FLAG_SECOND), "_span": C.reference_length(F.col("cigar"))})
    rows = rows.select(*kept, "contig", "_span").where("_span > 0")
    near = _with_sites(reference.overlapping(refs, margin, size), sites, margin, size)
    short = rows.where(F.col("_span") <= margin).withColumn("slice", F.expr(f"(contig_position - 1) div {size}")).join(near, ["contig", "slice"])
    last = F.col("contig_position") + F.col("_span") - 1
    short = short.select(*kept, F.substring("ref", (F.col("contig_position") - F.col("slice") * size).cast("int"), F.col("_span").cast("int")).alias("ref_seq"), F.filter("sites", lambda x: x.between(F.col("contig_position"), last)).alias("known"))
    long = with_known_positions(rows.where(F.col("_span") > margin), sites).withColumn("_end", F.col("contig_position") + F.col("_span") - 1)
    long = reference.with_reference(long, refs, "contig_position", "_end").select(*kept, "ref_seq", "known")
    return short.unionByName(long)


def _with_sites(slices: DataFrame, sites: DataFrame, margin: int, size: int) -> DataFrame:
    """(contig, slice, ref, sites) of overlapping slices and the known positions in them."""
    here = F.expr(f"(position - 1) div {size}")
    both = F.when((F.col("position") - 1) % size < margin, F.array(here, here - 1)).otherwise(F.array(here))
    placed = sites.select(F.col("contig").alias("_key"), F.col("position").cast("bigint").alias("position")).select("_key", "position", F.explode(both).alias("_slice"))
    packed = placed.groupBy("_key", "_slice").agg(F.collect_list("position").alias("sites"))  # no more than a slice has positions
    joined = slices.join(packed, (contig_key(F.col("contig")) == F.col("_key")) & (F.col("slice") == F.col("_slice")), "left")
    return joined.select("contig", "slice", F.col("seq").alias("ref"), F.coalesce("sites", F.array().cast("array<bigint>")).alias("sites"))


#: Letters as codes 0 to 3 of the alphabet, 4 for any other.
_CODES = np.full(256, 4, np.int64)
for _i, _b in enumerate("ACGT"):
    _CODES[ord(_b)] = _i
_NO_CONTEXT = len("ACGT") ** CONTEXT
_LOW = "".join(chr(33 + q) for q in range(LOW_TAIL + 1))


class _Reads:
    """The reads of a batch as flat arrays, with the bases that covariates see: those of low quality at either end are masked."""

    def __init__(self, seqs: list[str], quals: list[str], reverse: np.ndarray, second: np.ndarray):
        self.seq, self.quals = K2.letters(seqs), K2.letters(quals)
        self.size, self.reverse, self.second = self.seq[2], reverse, second
        self.head = np.fromiter((len(q) - len(q.lstrip(_LOW)) for q in quals), np.int64, len(quals))
        self.tail = np.fromiter((len(q) - len(q.rstrip(_LOW)) for q in quals), np.int64, len(quals))

    def codes(self, read: np.ndarray, offset: np.ndarray) -> np.ndarray:
        code = _CODES[K2.upper(K2.picked(self.seq, read, offset))]
        return np.where((offset < self.head[read]) | (offset >= self.size[read] - self.tail[read]), 4, code)

    def quality(self, read: np.ndarray, offset: np.ndarray) -> np.ndarray:
        return K2.picked(self.quals, read, offset).astype(np.int64) - 33

    def covariates(self, read: np.ndarray, offset: np.ndarray, max_cycle: int) -> tuple[np.ndarray, np.ndarray]:
        """(context, cycle + max_cycle) of bases: the context in the order of sequencing, ``_NO_CONTEXT`` at the start or next to an N; the cycle counts from
        the first sequenced base, negative for second mates, and is 0 beyond ``max_cycle``."""
        reverse = self.reverse[read]
        own, before = self.codes(read, offset), self.codes(read, np.where(reverse, offset + 1, offset - 1))
        before = np.where(np.where(reverse, offset + CONTEXT <= self.size[read], offset >= CONTEXT - 1), before, 4)
        context = np.where(reverse, (3 - before) * 4 + (3 - own), before * 4 + own)  # the complement of a code is 3 less the code
        step = np.where(reverse, self.size[read] - offset, offset + 1)
        cycle = np.where(step <= max_cycle, np.where(self.second[read], -step, step), 0)
        return np.where((own > 3) | (before > 3), _NO_CONTEXT, context), cycle + max_cycle


def _context_text(code: int) -> str | None:
    return None if code == _NO_CONTEXT else "ACGT"[code // 4] + "ACGT"[code % 4]


_CELL = ["read_group", "qual", "covariate", "value"]
_COUNTS = "read_group string, qual int, covariate string, value string, observations bigint, errors bigint"


def counted(rows: DataFrame, max_cycle: int = MAX_CYCLE, more: dict[str, Callable[[str, str, bool], list[str | None]]] | None = None) -> DataFrame:
    """(read_group, qual, covariate, value, observations, errors) of the bases of ``reads_on_reference``: all bases under a null covariate, and again by context and by cycle.

    Left out: positions without reference, irregular bases, qualities below ``MIN_QUALITY``, known sites. The value is null where a base has no context (at the
    start of a read or next to an N) or no cycle (beyond ``max_cycle``); such bases count like all others.
    more: further covariates by name, each a function of a read's sequence, qualities and strand that gives a value for each base, or None.
    """

    def tally(batches):
        for batch in batches:
            get = lambda c, batch=batch: batch.column(c).to_numpy(zero_copy_only=False)
            starts = get("contig_position").astype(np.int64)
            groups = batch.column("read_group").dictionary_encode()
            names, group = groups.dictionary.to_pylist(), groups.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            reads = _Reads(batch.column("seq").to_pylist(), batch.column("base_quals").to_pylist(), get("is_reverse").astype(bool), get("is_second").astype(bool))
            els = K2.elements(batch.column("cigar").to_pylist(), starts)
            read, position, offset = (x[~els.deletion] for x in (els.read, els.position, els.offset))
            base, quality = _CODES[K2.upper(K2.picked(reads.seq, read, offset))], reads.quality(read, offset)
            ref = _CODES[K2.upper(K2.picked(K2.letters(batch.column("ref_seq").to_pylist()), read, position - starts[read]))]
            used = (base < 4) & (ref < 4) & (quality >= MIN_QUALITY)
            known = batch.column("known")
            if len(known.flatten()):
                of = np.repeat(np.arange(batch.num_rows), known.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                used &= ~np.isin((read << 40) + position, (of << 40) + known.flatten().to_numpy(zero_copy_only=False))
            read, offset, quality, wrong = read[used], offset[used], quality[used], (base != ref)[used]
            context, cycle = reads.covariates(read, offset, max_cycle)
            here = group[read] * 128 + quality
            # Each covariate is counted by itself: (read group, quality) by nothing, by context, by cycle.
            own = [(None, None, [None]), ("Context", context, contexts), ("Cycle", cycle, cycles)]
            for name, values_of in (more or {}).items():
                given = [values_of(s, q, bool(r)) for s, q, r in zip(batch.column("seq").to_pylist(), batch.column("base_quals").to_pylist(), reads.reverse, strict=True)]
                begins = np.cumsum([0, *map(len, given)])
                coded = pa.array([v for values in given for v in values], pa.string()).dictionary_encode()
                codes = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
                own.append((name, codes[begins[read] + offset], [*coded.dictionary.to_pylist(), None]))
            for covariate, value, texts in own:
                size = len(texts)
                code, place = np.unique(here if value is None else here * size + value, return_inverse=True)
                n, errors = np.bincount(place, minlength=len(code)).astype(np.int64), np.bincount(place, weights=wrong, minlength=len(code)).astype(np.int64)
                at = code // size
                columns = [_named(at // 128, names), pa.array(at % 128, pa.int32()), pa.array([covariate] * len(code), pa.string()), _named(code % size, texts), pa.array(n), pa.array(errors)]
                yield pa.RecordBatch.from_arrays(columns, names=["read_group", "qual", "covariate", "value", "observations", "errors"])

    contexts = [_context_text(i) for i in range(_NO_CONTEXT + 1)]
    cycles = [str(i) if i else None for i in range(-max_cycle, max_cycle + 1)]
    near = rows.hint("rebalance", F.col("read_group")).sortWithinPartitions("read_group")  # else a batch has few bases of each of many read groups; a large group is split
    return near.mapInArrow(tally, _COUNTS).groupBy(*_CELL).agg(*_datum())


def _named(codes: np.ndarray, names: list[str | None]) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(codes, pa.int64()))


def _datum() -> list[Column]:
    return [F.sum("observations").alias("observations"), F.sum("errors").alias("errors")]


def tables(counts: DataFrame) -> DataFrame:
    """All recalibration tables by roll-up of the counts: (level, read_group, qual, covariate, value, observations, errors, reported).

    level 0: read group; 1: and quality; 2: and one covariate's value. ``reported`` is the quality that the reported error rates add up to.
    """
    expected = counts.withColumn("expected", F.col("observations") * F.pow(F.lit(10.0), F.col("qual") / -10.0))
    own = expected.where("covariate is null or value is not null").withColumn("level", F.when(F.col("covariate").isNull(), 1).otherwise(2))
    groups = expected.where("covariate is null").groupBy("read_group").agg(*_datum(), F.sum("expected").alias("expected"))
    groups = groups.withColumns({"level": F.lit(0), "qual": F.lit(None).cast("int"), "covariate": F.lit(None).cast("string"), "value": F.lit(None).cast("string")})
    both = own.unionByName(groups).withColumn("reported", -10 * F.log10(F.col("expected") / F.col("observations")))
    return both.select("level", "read_group", "qual", "covariate", "value", "observations", "errors", "reported")


def merged(parts: list[DataFrame]) -> DataFrame:
    """Counts of several runs as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*_CELL).agg(*_datum())


def empirical_error(observations: Column, errors: Column) -> Column:
    return (errors + 1) / (observations + 2)


def with_empirical(rows: DataFrame) -> DataFrame:
    """Add the ``empirical`` quality: the bin of the largest posterior given counts and reported quality."""

    @F.pandas_udf("double")
    def estimate(observations: pd.Series, errors: pd.Series, reported: pd.Series) -> pd.Series:
        return pd.Series(K.bayesian_qualities(observations.to_numpy(), errors.to_numpy(), reported.to_numpy()))

    return rows.withColumn("empirical", estimate(F.col("observations").cast("double"), F.col("errors").cast("double"), F.col("reported").cast("double")))


def quality_histogram(level1: DataFrame) -> DataFrame:
    """(quality, observations) by rounded empirical quality."""
    return level1.groupBy(F.least(F.round("empirical").cast("int"), F.lit(K.MAX_REPORTED)).alias("quality")).agg(F.sum("observations").alias("observations"))


def quantization(histogram: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(quality, quantized) for 0..93. The histogram has 94 rows at most."""
    slots = [0] * (K.MAX_REPORTED + 1)
    for q, n in histogram.collect():
        slots[q] = n
    spark = histogram.sparkSession
    return spark.createDataFrame(list(enumerate(K.quantized(slots, levels))), "quality int, quantized int")


def _shifts(table: pa.Table, max_cycle: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(shift of the read group, empirical quality by quality, by quality and context, by quality and cycle), NaN where there is none, of one read group's tables."""
    by_quality, by_context, by_cycle = np.full(128, np.nan), np.full((128, _NO_CONTEXT + 1), np.nan), np.full((128, 2 * max_cycle + 1), np.nan)
    codes = {_context_text(i): i for i in range(_NO_CONTEXT)}
    overall = 0.0
    columns = (table.column(c).to_pylist() for c in ("level", "qual", "covariate", "value", "reported", "empirical"))
    for level, qual, covariate, value, reported, empirical in zip(*columns, strict=True):
        if level == 0:
            overall = empirical - reported
        elif level == 1:
            by_quality[qual] = empirical
        elif covariate == "Context":
            by_context[qual, codes[value]] = empirical
        elif abs(int(value)) <= max_cycle:
            by_cycle[qual, int(value) + max_cycle] = empirical
    return overall, by_quality, by_context, by_cycle


def recalibrated(reads: DataFrame, estimated: DataFrame, max_cycle: int = MAX_CYCLE, block: int = 50_000) -> DataFrame:
    """The reads with new ``base_quals`` and the old ones as ``old_quals``: the shifts of read group, quality, context and cycle added up for each base; qualities under ``MIN_QUALITY`` stay.

    Reads without a read group, sequence or qualities, or with texts of two lengths, come out as they are. The tables of a read group
    meet its reads in blocks of about ``block``, so neither a large group nor many groups are gathered or sent to all tasks.
    """
    flag = lambda bit: F.col("flag").bitwiseAND(bit) != 0
    sound = F.coalesce(F.expr("read_group is not null and seq not in ('', '*') and base_quals not in ('', '*') and length(seq) = length(base_quals)"), F.lit(False))
    rows = reads.where(sound).withColumns({"_reverse": F.coalesce(flag(FLAG_REVERSE), F.lit(False)), "_second": F.coalesce(flag(FLAG_PAIRED) & flag(FLAG_SECOND), F.lit(False))})
    sizes = rows.groupBy(F.col("read_group").alias("_group")).agg(F.expr(f"(count(1) + {block - 1}) div {block}").alias("_blocks"))
    parts = rows.join(sizes, F.col("read_group") == F.col("_group")).withColumn("_block", F.pmod(F.xxhash64("record_id", "seq"), F.col("_blocks"))).drop("_blocks")
    copies = estimated.select(F.col("read_group").alias("_group"), "level", "qual", "covariate", "value", "reported", "empirical").join(sizes, "_group").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))).drop("_blocks")

    names = reads.columns

    def applied(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        get = lambda c: left.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        old = left.column("base_quals").to_pylist()
        if not old:
            new: list[str] = []
        else:
            batch = _Reads(left.column("seq").to_pylist(), old, get("_reverse").astype(bool), get("_second").astype(bool))
            read = np.repeat(np.arange(len(old)), batch.size)
            offset = np.arange(len(read)) - np.repeat(batch.quals[1], batch.size)
            quality = batch.quality(read, offset)
            context, cycle = batch.covariates(read, offset, max_cycle)
            overall, by_quality, by_context, by_cycle = _shifts(right, max_cycle)
            level = np.clip(quality, 0, 127)
            here = np.where(np.isnan(by_quality[level]), quality + overall, by_quality[level])
            more = [np.nan_to_num(x - here, nan=0.0) for x in (by_context[level, context], by_cycle[level, cycle])]
            total = np.clip(np.floor(here + more[0] + more[1] + 0.5), 1, K.MAX_REPORTED)
            text = (np.where(quality < MIN_QUALITY, quality, total).astype(np.uint8) + 33).tobytes().decode("latin-1")
            new = [text[b : b + n] for b, n in zip(batch.quals[1].tolist(), batch.size.tolist(), strict=True)]
        out = left.select(names)
        return out.set_column(out.schema.get_field_index("base_quals"), "base_quals", pa.array(new, pa.string())).append_column("old_quals", pa.array(old, pa.string()))

    schema = T.StructType([*reads.schema.fields, T.StructField("old_quals", T.StringType())])
    key = ["_group", "_block"]
    done = parts.groupBy(*key).cogroup(copies.groupBy(*key)).applyInArrow(applied, schema)
    return done.unionByName(reads.where(~sound).withColumn("old_quals", F.col("base_quals")))


def recalibration(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, estimated tables) of ``reads_on_reference``; both are small and staged."""
    counts = staged(counted(rows), "recal-counts")
    return counts, staged(with_empirical(tables(counts)), "recal-tables")
