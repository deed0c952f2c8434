"""How sure positions are to be as the reference: likelihoods per sample and position, reference blocks from them, and genotypes of many samples together.

Reads meet the reference once, and one pass over batches of reads gives partial sums per sample and position. What is shuffled is one row per batch, sample and position.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import cigar as C
from strandlake.kernels import columns as K
from strandlake.kernels import genotype
from strandlake.operators import intervals, ordered, pileup, reference
from strandlake.operators import variants as V
from strandlake.operators.periods import gvcf_end
from strandlake.tables import with_contig

#: Bases up to this quality don't count, quality of a deletion, longest indel looked for, most informative reads that count, chance of an
#: indel error (log10), largest genotype quality, and the phred quality from which a site is called.
LOW_QUALITY, DELETION_QUALITY, MAX_INDEL, MAX_INFORMATIVE, INDEL_ERROR, MAX_GQ, CALLED = 6, 30, 10, 40, -4.5, 99, 30.0
NON_REF = "<NON_REF>"
_SUMS = ["depth", "informative", "gl_ref", "gl_het", "gl_hom"]
_SCHEMA = "sample string, contig string, position bigint, ref string, depth bigint, informative bigint, gl_ref double, gl_het double, gl_hom double"


def informative_offsets(seq: np.ndarray, quals: np.ndarray, ref: np.ndarray, diagonal: int, longest: int = MAX_INDEL) -> np.ndarray:
    """For each offset of a read: whether no insertion or deletion of up to ``longest`` bases right there matches the rest of the read as well as none does.

    diagonal: reference offset less read offset. An offset with less than ``longest`` bases of read or reference left tells nothing.
    """
    n, m = len(seq), len(ref)

    def suffix(d: int) -> np.ndarray:
        place = np.arange(n) + d
        inside = (place >= 0) & (place < m)
        cost = np.where(inside & (ref[np.clip(place, 0, max(0, m - 1))] != seq), quals, 0) if m else np.zeros(n, np.int64)
        return np.append(np.cumsum(cost[::-1])[::-1], np.zeros(longest + 1, np.int64))

    plain = suffix(diagonal)[:n]
    o = np.arange(n)
    good = (n - o >= longest) & (m - o - diagonal >= longest)
    for size in range(1, longest + 1):
        good &= (suffix(diagonal + size)[:n] > plain) & (suffix(diagonal - size)[size : n + size] > plain)
    return good


def likelihoods(reads: DataFrame, read_groups: DataFrame, contigs: DataFrame, refs: DataFrame, preset: str = "active_region") -> DataFrame:
    """(sample, contig, position, ref, depth, informative, gl_ref, gl_het, gl_hom) of every position with reads and a reference base.

    Other bases, deletions and neighbours of indels and soft clips count as alternate. informative: reads that would show an indel right after the position.
    """
    rows = pileup.read_rows(reads, read_groups, contigs, preset).where("seq not in ('', '*') and base_quals not in ('', '*') and length(seq) = length(base_quals)")
    rows = rows.where(C.read_length(F.col("cigar")) == F.length("seq"))
    rows = rows.select("record_id", "sample", "contig", F.col("contig_position").cast("bigint").alias("contig_position"), C.reference_length(F.col("cigar")).alias("_span"), "cigar", "seq", "base_quals").where("_span > 0")
    rows = reference.on_slices(rows, refs, "_span", extra=MAX_INDEL)

    def sums(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = batch.column("contig_position").to_numpy(zero_copy_only=False).astype(np.int64)
            seqs, quals, ref = (K.letters(batch.column(c).to_pylist()) for c in ("seq", "base_quals", "ref_seq"))
            els = K.elements(batch.column("cigar").to_pylist(), starts)
            base, of_ref = K.upper(K.picked(seqs, els.read, els.offset)), K.upper(K.picked(ref, els.read, els.position - starts[els.read]))
            quality = np.where(els.deletion, DELETION_QUALITY, K.picked(quals, els.read, els.offset).astype(np.int64) - 33)
            used = (of_ref != ord("N")) & (of_ref > 0) & (quality > LOW_QUALITY)
            beside = lambda op: np.isin(op, (K.INSERTION, K.DELETION, K.SOFT))
            alt = els.deletion | beside(els.next_op) | beside(els.prev_op) | (base != of_ref)
            e = 10.0 ** (-quality / 10.0)
            hit, miss, half = np.log10(np.maximum(1e-300, 1 - e)), np.log10(e / 3), np.log10((1 - e) / 2 + e / 6)
            tells = np.zeros(len(els.read), bool)
            diagonal = els.position - starts[els.read] - els.offset
            for i in range(batch.num_rows):
                mine = np.arange(*np.searchsorted(els.read, [i, i + 1]))  # elements come in the order of reads
                mine = mine[~els.deletion[mine]]
                s, q = K.upper(seqs[0][seqs[1][i] : seqs[1][i] + seqs[2][i]]), quals[0][quals[1][i] : quals[1][i] + quals[2][i]].astype(np.int64) - 33
                window = K.upper(ref[0][ref[1][i] : ref[1][i] + ref[2][i]])
                for d in np.unique(diagonal[mine]):
                    here = mine[diagonal[mine] == d]
                    tells[here] = informative_offsets(s, q, window, int(d))[els.offset[here]]
            samples = batch.column("sample").dictionary_encode()
            names = batch.column("contig").dictionary_encode()
            group = samples.indices.fill_null(len(samples.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64) * (len(names.dictionary) + 1) + names.indices.to_numpy(zero_copy_only=False)
            key = (group[els.read] << 40) + els.position
            keys, place = np.unique(key[used], return_inverse=True)
            total = lambda x: np.bincount(place, weights=x[used], minlength=len(keys))
            letter = np.zeros(len(keys), np.uint8)
            letter[place] = of_ref[used]
            of_group = keys >> 40
            columns = [
                pa.array([*samples.dictionary.to_pylist(), None], pa.string()).take(pa.array(of_group // (len(names.dictionary) + 1))),
                names.dictionary.take(pa.array(of_group % (len(names.dictionary) + 1))),
                pa.array(keys & ((1 << 40) - 1)),
                pa.array(list(letter.tobytes().decode("latin-1")), pa.string()),
                pa.array(np.bincount(place, minlength=len(keys)).astype(np.int64)),
                pa.array(total(tells.astype(float)).astype(np.int64)),
                pa.array(total(np.where(alt, miss, hit))),
                pa.array(total(half)),
                pa.array(total(np.where(alt, hit, miss))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["sample", "contig", "position", "ref", *_SUMS])

    return rows.mapInArrow(sums, _SCHEMA).groupBy("sample", "contig", "position", "ref").agg(*(F.sum(c).alias(c) for c in _SUMS))


def with_genotype_quality(rows: DataFrame) -> DataFrame:
    """Add ``pl`` and ``gq`` of the less sure of two models: single bases, and indels from the number of informative reads."""
    n = F.least(F.col("informative"), F.lit(MAX_INFORMATIVE))
    error = 10.0**INDEL_ERROR
    models = {"base": [F.col(c) for c in _SUMS[2:]], "indel": [n * float(np.log10(1 - error)), n * float(np.log10(0.5)), n * INDEL_ERROR]}
    scored = {}
    for name, (r, h, a) in models.items():
        best = F.greatest(r, h, a)
        pl = [F.round(-10 * (x - best)).cast("int") for x in (r, h, a)]
        scored[name] = (F.array(*pl), F.least(F.greatest(F.lit(0), F.least(pl[1], pl[2]) - pl[0]), F.lit(MAX_GQ)))
    less = scored["indel"][1] < scored["base"][1]
    return rows.withColumns({"pl": F.when(less, scored["indel"][0]).otherwise(scored["base"][0]), "gq": F.when(less, scored["indel"][1]).otherwise(scored["base"][1])})


def blocks(rows: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Reference blocks (sample, contig, from_position, to_position, ref, min_gq, min_dp, min_pl, alt) of positions with ``gq`` and ``pl``.

    Neighbouring positions of a quality band make one; calls (sample, contig, from_position, to_position) end a block and are not in any.
    """
    kept = rows.select(F.coalesce("sample", F.lit("")).alias("sample"), "contig", "position", "ref", "depth", "gq", "pl")
    if calls is not None:
        covered = intervals.range_join(kept.withColumn("_to", F.col("position")), calls.select(F.coalesce("sample", F.lit("")).alias("sample"), "contig", "from_position", "to_position"), ["sample", "contig"], "position", "_to", "from_position", "to_position", width=1 << 12)
        kept = kept.join(covered.select("sample", "contig", "position").distinct(), ["sample", "contig", "position"], "left_anti")
    kept = kept.withColumn("band", V.gq_band(F.col("gq")))
    runs = ordered.with_island(kept, ["sample", "contig"], "position", [], ["position", "band"], lambda p: (F.col("position") > p["position"] + 1) | (F.col("band") != p["band"]))
    least = [F.min(F.get("pl", F.lit(i))).alias(f"_{i}") for i in range(3)]
    whole = runs.groupBy("sample", "contig", "island").agg(F.min("position").alias("from_position"), F.max("position").alias("to_position"), F.min_by("ref", "position").alias("ref"), F.min("gq").alias("min_gq"), F.min("depth").alias("min_dp"), F.max("depth").alias("max_dp"), *least)
    return whole.select(F.nullif("sample", F.lit("")).alias("sample"), "contig", "from_position", "to_position", "ref", F.lit(NON_REF).alias("alt"), "min_gq", "min_dp", "max_dp", F.array("_0", "_1", "_2").alias("min_pl"))


def joint_likelihoods(records: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig, position, ref, alt, sample, pl_ref, pl_het, pl_hom, depth, own): every alternate of one-sample records with all samples that have a record over its place.

    A sample's own record of the alternate counts; else its likelihoods of any other allele (``<NON_REF>``) do; null where it has none. Of several records of a sample
    one of its own goes first, then the smallest id.
    """
    number = lambda key: F.transform(F.split(V.sample_value(F.col("format_keys"), F.col("genotype"), key), ","), lambda x: x.try_cast("int"))
    rows = with_contig(records, contigs, out="contig").where("contig is not null").select("record_id", F.col("sample_name").alias("sample"), "contig", F.col("contig_position").cast("bigint").alias("a"), gvcf_end().cast("bigint").alias("b"), F.col("ref_allele").alias("ref"), V.alts(F.col("alt")).alias("alts"), number("PL").alias("pl"), F.get(number("DP"), F.lit(0)).alias("depth"))
    sites = rows.select("contig", F.col("a").alias("position"), "ref", F.explode("alts").alias("alt")).where(~F.col("alt").isin(NON_REF, "*", ".")).distinct().withColumn("_to", F.col("position"))
    theirs = rows.where("a <= b").withColumnsRenamed({"ref": "r_ref"})
    pairs = intervals.range_join(sites, theirs, ["contig"], "position", "_to", "a", "b", width=1 << 12)
    own = (F.col("a") == F.col("position")) & (F.col("r_ref") == F.col("ref")) & F.array_contains("alts", F.col("alt"))
    k = F.when(own, F.array_position("alts", F.col("alt"))).otherwise(F.array_position("alts", NON_REF)).cast("int")
    pairs = pairs.withColumns({"own": own, "_k": F.when(k > 0, k)})
    # Likelihoods are of all alleles, or of all but <NON_REF>, which then has none.
    full = lambda n: ((n + 1) * (n + 2) / 2).cast("int")
    whole = F.size("pl").isin(full(F.size("alts")), full(F.size(F.array_remove("alts", NON_REF)))) & (F.size("pl") > F.coalesce(F.col("_k") * (F.col("_k") + 3) / 2, F.lit(0)))
    pl = lambda i: F.when(whole, F.get("pl", i.cast("int")))
    value = F.struct(F.when(F.col("_k").isNotNull(), pl(F.lit(0))).alias("pl_ref"), pl(F.col("_k") * (F.col("_k") + 1) / 2).alias("pl_het"), pl(F.col("_k") * (F.col("_k") + 3) / 2).alias("pl_hom"), "depth", "own")
    best = pairs.groupBy("contig", "position", "ref", "alt", "sample").agg(F.min_by(value, F.struct(~F.col("own"), "record_id")).alias("v"))
    return best.select("contig", "position", "ref", "alt", "sample", "v.*")


def joint_genotypes(rows: DataFrame, least: float = CALLED) -> DataFrame:
    """Rows of ``joint_likelihoods`` with genotype and quality per sample, and per alternate its quality and AC, AN and AF; alternates below ``least`` go.

    The sites' quality is the exact posterior over all samples with likelihoods; a site has one value per sample.
    """
    known = F.col("pl_ref").isNotNull() & F.col("pl_het").isNotNull() & F.col("pl_hom").isNotNull()
    best = F.least("pl_ref", "pl_het", "pl_hom")
    gt = F.when(~known, "./.").when(F.col("pl_ref") == best, "0/0").when(F.col("pl_het") == best, "0/1").otherwise("1/1")
    second = F.array_sort(F.array("pl_ref", "pl_het", "pl_hom"))[1]
    called = rows.withColumns({"gt": gt, "gq": F.when(known, F.least(second - best, F.lit(MAX_GQ)))})
    keys = ["contig", "position", "ref", "alt"]
    copies = F.when(F.col("gt") == "0/1", 1).when(F.col("gt") == "1/1", 2).otherwise(0)
    sites = called.groupBy(*keys).agg(F.sum(copies).alias("ac"), (2 * F.count_if(known)).alias("an"), F.sort_array(F.collect_list(F.when(known, F.struct("sample", "pl_ref", "pl_het", "pl_hom")))).alias("_p"))

    @F.pandas_udf("double")
    def quality(pls: pd.Series) -> pd.Series:
        return pd.Series([genotype.site_quality([np.array([x["pl_ref"], x["pl_het"], x["pl_hom"]]) / -10.0 for x in site])[0] if len(site) else 0.0 for site in pls])

    kept = sites.withColumn("qual", quality("_p")).where((F.col("qual") >= least) & (F.col("ac") > 0)).select(*keys, "qual", "ac", "an", (F.col("ac") / F.col("an")).alias("af"))
    return called.join(kept, keys)


__all__ = ["blocks", "informative_offsets", "joint_genotypes", "joint_likelihoods", "likelihoods", "with_genotype_quality"]
