"""Local realignment of reads around indels, whatever the depth of a target.

The consensuses of a target are the known indels in it and those that its reads show. Every read is scored against each of them, in blocks of reads, and the
gains are summed over blocks; the consensus with the largest gain is taken if it is large enough and leaves fewer mismatching columns than there
were (the entropy test, from sums per column over all reads). No read is left out and no target is one task.

Defined results: reads with clips or skipped reference, and those whose sequence, qualities and CIGAR differ in length, are neither scored nor moved, nor do they show
an indel; a target without reads or consensus changes nothing; of equal gains the first consensus in the order of (position, deleted, inserted) is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import cigar as C
from strandlake.kernels import realign as A
from strandlake.kernels import reads as R
from strandlake.operators import intervals, pileup, reference
from strandlake.operators.calling import _batch, _keyed, _rows
from strandlake.session import staged
from strandlake.tables import FLAG_FIRST, FLAG_SECOND, FLAG_SECONDARY, FLAG_SUPPLEMENTARY, contig_key, with_sample

#: Share of a column's qualities that mismatches from which it counts as mismatching, what of that must go for a column to be cleaned,
#: and what a moved read's mapping quality gains, up to its cap.
MISMATCHING, CLEANED, MAPQ_GAIN, MAPQ_CAP = 0.15, 0.75, 10, 254
_EVENT = "struct<at:bigint,gone:bigint,new:string>"
_SCORES = "contig string, start bigint, event int, gain bigint"
_MOVES = "contig string, start bigint, record_id bigint, new_position bigint, new_cigar string, position bigint, total bigint, wrong_before bigint, covered_after bigint, wrong_after bigint"


def known_events(variants: DataFrame) -> DataFrame:
    """(contig, at, gone, new) of the simple indels of variants: at is the last position before the event."""
    each = variants.select(contig_key(F.col("contig_name")).alias("contig"), F.col("contig_position").cast("bigint").alias("_p"), F.upper("ref_allele").alias("_r"), F.explode(F.split(F.upper("alt"), ",")).alias("_a"))
    one_base = (F.left("_r", F.lit(1)) == F.left("_a", F.lit(1))) & F.col("_a").rlike("^[ACGT]+$") & F.col("_r").rlike("^[ACGT]+$")
    simple = each.where(F.col("contig").isNotNull() & one_base & (F.length("_r") != F.length("_a")) & (F.least(F.length("_r"), F.length("_a")) == 1))
    return simple.select("contig", F.col("_p").alias("at"), (F.length("_r") - 1).cast("bigint").alias("gone"), F.substring("_a", F.lit(2), F.length("_a")).alias("new")).distinct()


def _scorable() -> Column:
    return ~F.col("cigar").rlike("[SHN]") & (C.read_length(F.col("cigar")) == F.length("seq")) & (F.length("seq") == F.length("base_quals"))


def _target_reads(targets: DataFrame, rows: DataFrame) -> DataFrame:
    a, last = F.col("contig_position").cast("bigint"), F.col("contig_position") + C.reference_length(F.col("cigar")) - 1
    spans = rows.where(_scorable()).select("record_id", "contig", a.alias("a"), last.cast("bigint").alias("b"), "cigar", F.upper("seq").alias("seq"), "base_quals")
    return intervals.range_join(targets.select("contig", "start", "stop"), spans, ["contig"], "start", "stop", "a", "b", width=1 << 12).select("contig", "start", "record_id", "a", "cigar", "seq", "base_quals")


def _events(groups: DataFrame, targets: DataFrame, known: DataFrame | None) -> DataFrame:
    """(contig, start, events) of the distinct indels of each target, in order."""

    @F.pandas_udf(_EVENT)
    def shown(start: pd.Series, cigar: pd.Series, seq: pd.Series, quals: pd.Series) -> pd.DataFrame:
        found = [A.indel_of(R.Read.of(int(a), c, s, q)) or (None, None, None) for a, c, s, q in zip(start, cigar, seq, quals, strict=True)]
        return pd.DataFrame(found, columns=["at", "gone", "new"])

    of_reads = groups.where(F.col("cigar").rlike("[ID]")).select("contig", "start", shown("a", "cigar", "seq", "base_quals").alias("e")).where("e.at is not null")
    both = of_reads.select("contig", "start", "e.at", "e.gone", "e.new")
    if known is not None:
        named = known.select(F.col("contig").alias("_key"), "at", "gone", "new", (F.col("at") + F.col("gone") + 1).alias("_last"))
        keyed = targets.select("contig", "start", "stop", contig_key(F.col("contig")).alias("_key"))
        both = both.unionByName(intervals.range_join(keyed, named, ["_key"], "start", "stop", "at", "_last", width=1 << 12).select("contig", "start", "at", "gone", "new"))
    return both.groupBy("contig", "start").agg(F.array_sort(F.collect_set(F.struct("at", "gone", "new"))).alias("events"))


#: Rows of results that are written at once.
_WRITTEN = 1 << 13
_SCORES_ARROW = pa.schema([("contig", pa.string()), ("start", pa.int64()), ("event", pa.int32()), ("gain", pa.int64())])
_MOVES_ARROW = pa.schema([(c, pa.string() if c in ("contig", "new_cigar") else pa.int64()) for c in (x.split()[0] for x in _MOVES.split(", "))])
_READ = ["record_id", "a", "cigar", "seq", "base_quals"]


def _event(e: dict) -> tuple[int, int, str]:
    return int(e["at"]), int(e["gone"]), e["new"]


def _blocks(batches: Iterator[pa.RecordBatch], of_target: int) -> Iterator[tuple]:
    """(contig, start, the target's ``of_target`` columns, [(record_id, read)]) of each block of reads; its first row is its target."""
    for (contig, start, _), rows in groupby(_rows(batches), key=itemgetter(0, 1, 2)):
        kind, *first = next(rows)[3:]
        if kind == 0:
            yield contig, start, first[len(_READ) : len(_READ) + of_target], [(record, R.Read.of(a, c, s, q)) for _, _, _, _, record, a, c, s, q, *_ in rows]


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for contig, start, (ref, ref_start, events), reads in _blocks(batches, 3):
        raw = [A.raw_mismatches(r, ref, ref_start) for _, r in reads]
        for k, e in enumerate(events if reads else ()):
            target = A.consensus(ref, ref_start, _event(e))
            if target is not None:
                gains = (n - A.best_place(r, target, ref_start)[1] for (_, r), n in zip(reads, raw, strict=True) if n)
                out.append((contig, start, k, sum(g for g in gains if g > 0)))
        if len(out) >= _WRITTEN:
            yield _batch(out, _SCORES_ARROW)
            out = []
    if out:
        yield _batch(out, _SCORES_ARROW)


def _add_columns(read: R.Read, letters: np.ndarray, ref_start: int, sums: np.ndarray, covered: np.ndarray) -> None:
    """Add the qualities of a read's aligned bases, and those that mismatch, to the two rows of ``sums``, and mark the columns; none where the reference is N."""
    seq, qual, at, i = A.letters_of(read.seq), A.qualities_of(read), read.start - ref_start, 0
    for op, n in read.ops:
        if op in "M=X":
            a = max(at, 0)
            b = min(at + n, len(letters))
            if a < b:
                there, own, q = letters[a:b], seq[i + a - at : i + b - at], qual[i + a - at : i + b - at]
                known = there != 78
                sums[0, a:b] += np.where(known, q, 0)
                sums[1, a:b] += np.where(known & (there != own), q, 0)
                covered[a:b] |= known
        at += n if op in "MDN=X" else 0
        i += n if op in "MIS=X" else 0


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: reads that move (record_id set), and sums per column before and after (position set).

    Of a target that is one block, columns without a mismatch on either side decide nothing; but for one they don't come out.
    """
    moves, columns, n = [], [], 0

    def out() -> Iterator[pa.RecordBatch]:
        if moves:
            yield _batch([(*x, *[None] * 5) for x in moves], _MOVES_ARROW)
        if columns:
            size = [len(at) for _, _, at, _ in columns]
            own = {"contig": pa.array([c for c, *_ in columns], pa.string()), "start": pa.array([s for _, s, *_ in columns], pa.int64())}
            each = pa.array(np.repeat(np.arange(len(size)), size))
            own = {c: x.take(each) for c, x in own.items()} | {"position": pa.array(np.concatenate([at for _, _, at, _ in columns]))}
            cells = np.concatenate([x for *_, x in columns], axis=1)
            own |= {c: pa.array(np.ascontiguousarray(x)) for c, x in zip(("total", "wrong_before", "covered_after", "wrong_after"), cells, strict=True)}
            yield pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(sum(size), f.type)) for f in _MOVES_ARROW], schema=_MOVES_ARROW)

    for contig, start, (ref, ref_start, chosen, blocks), reads in _blocks(batches, 4):
        event, letters = _event(chosen), A.letters_of(ref)
        target = A.consensus(ref, ref_start, event)
        sums, covered = np.zeros((4, len(letters)), np.int64), np.zeros(len(letters), bool)
        for record, read in reads:
            after, raw = read, A.raw_mismatches(read, ref, ref_start)
            if raw:
                offset, cost = A.best_place(read, target, ref_start)
                if cost < raw:
                    place, ops = A.placed(offset, len(read.seq), event, ref_start)
                    after = R.Read(place, ops, read.seq, read.quals)
            if (after.start, after.cigar) != (read.start, read.cigar):
                moves.append((contig, start, record, after.start, after.cigar))
            _add_columns(read, letters, ref_start, sums[:2], covered)
            _add_columns(after, letters, ref_start, sums[2:], covered)
        at = np.flatnonzero(covered)
        if blocks == 1 and len(at):
            wrong = (sums[1, at] > 0) | (sums[3, at] > 0)
            at = at[wrong] if wrong.any() else at[:1]
        if len(at):
            columns.append((contig, start, at + ref_start, sums[:, at]))
            n += len(at)
        if n + len(moves) >= _WRITTEN:
            yield from out()
            moves, columns, n = [], [], 0
    yield from out()


def _less_mismatching(columns: DataFrame) -> DataFrame:
    """(contig, start) of the targets with no mismatching column before, or with fewer after."""
    before = F.col("wrong_before") / F.col("total")
    after = F.col("wrong_after") / F.col("covered_after")
    was = (F.col("total") > 0) & (before > MISMATCHING)
    still = F.when(was, (F.col("covered_after") > 0) & (after > before * (1 - CLEANED))).otherwise((F.col("covered_after") > 0) & (after > MISMATCHING))
    per = columns.groupBy("contig", "start").agg(F.count_if(was).alias("was"), F.count_if(still).alias("still"))
    return per.where("was = 0 or still < was").select("contig", "start")


def realigned(targets: DataFrame, reads: DataFrame, read_groups: DataFrame, contigs: DataFrame, refs: DataFrame, variants: DataFrame | None = None, padding: int = 230, block: int = 512, min_lod: float = A.MIN_LOD, entropy: bool = True) -> DataFrame:
    """(contig, start, record_id, new_position, new_cigar, lod) of the reads that move; ``variants`` are known ones, whose simple indels are tried too.

    entropy: whether a consensus must also leave fewer mismatching columns.
    """
    rows = pileup.read_rows(reads, read_groups, contigs, "do_not_realign").where("seq not in ('', '*')")
    groups = staged(_target_reads(targets, rows), "target-reads")
    keyed = targets.select("contig", "start", "stop").withColumn("target", F.concat_ws(":", "contig", "start"))
    with_ref = reference.with_reference(keyed, refs, "start", "stop", key="target", padding=padding).drop("target")
    sizes = groups.groupBy("contig", "start").agg(F.expr(f"(count(1) + {block - 1}) div {block}").alias("_blocks"))
    known = None if variants is None else known_events(variants)
    info = staged(with_ref.join(_events(groups, targets, known), ["contig", "start"]).join(sizes, ["contig", "start"]), "target-events")
    key = ["contig", "start", "_block"]
    dealt = groups.join(info.select("contig", "start", "_blocks"), ["contig", "start"]).withColumn("_block", F.pmod(F.xxhash64("record_id"), F.col("_blocks"))).drop("_blocks")

    def walked(reads: DataFrame, found: DataFrame, of_target: list[str], function, schema: str) -> DataFrame:
        none = lambda rows, names: [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names]
        copies = found.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
        first = copies.select(*key, F.lit(0).alias("_kind"), *none(reads, _READ), *of_target)
        return _keyed(first.unionByName(reads.select(*key, F.lit(1).alias("_kind"), *_READ, *none(found, of_target))), key, "_kind").mapInArrow(function, schema)

    scores = walked(dealt, info, ["ref_seq", "ref_start", "events"], _scored, _SCORES)
    gains = scores.groupBy("contig", "start", "event").agg(F.sum("gain").alias("gain"))
    best = gains.groupBy("contig", "start").agg(F.max(F.struct("gain", (-F.col("event")).alias("minus"))).alias("b")).where(F.col("b.gain") / 10 >= min_lod)
    chosen = info.join(best, ["contig", "start"]).withColumns({"chosen": F.get("events", -F.col("b.minus")), "lod": F.col("b.gain") / 10}).drop("events", "b")
    chosen = staged(chosen, "chosen-events")
    part = dealt.join(chosen.select("contig", "start"), ["contig", "start"], "left_semi")
    moved = staged(walked(part, chosen, ["ref_seq", "ref_start", "chosen", "_blocks"], _moved, _MOVES), "moves")
    found = moved.where("record_id is not null").join(chosen.select("contig", "start", "lod"), ["contig", "start"])
    if entropy:
        columns = moved.where("position is not null").groupBy("contig", "start", "position").agg(*(F.sum(c).alias(c) for c in ("total", "wrong_before", "covered_after", "wrong_after")))
        found = found.join(_less_mismatching(columns), ["contig", "start"], "left_semi")
    return found.select("contig", "start", "record_id", "new_position", "new_cigar", "lod")


def with_moves(reads: DataFrame, moves: DataFrame) -> DataFrame:
    """The reads with the place and CIGAR they move to, and their mapping quality raised; a read that two targets move follows the larger LOD.

    The tags that the old alignment decided (MD, and NM and UQ, which are of the old place) are dropped.
    """
    one = moves.groupBy("record_id").agg(F.max_by(F.struct("new_position", "new_cigar"), F.struct("lod", (-F.col("start")).alias("s"))).alias("_m"))
    joined = reads.join(one, "record_id", "left")
    raised = F.when(F.col("map_q") < 255, F.least(F.col("map_q") + MAPQ_GAIN, F.lit(MAPQ_CAP))).otherwise(F.col("map_q"))
    has = F.col("_m").isNotNull()
    changed = {
        "contig_position": F.when(has, F.col("_m.new_position").cast("int")).otherwise(F.col("contig_position")),
        "cigar": F.when(has, F.col("_m.new_cigar")).otherwise(F.col("cigar")),
        "map_q": F.when(has, raised).otherwise(F.col("map_q")),
        "attributes": F.when(has, F.filter("attributes", lambda t: ~t.rlike("^(MD|NM|UQ):"))).otherwise(F.col("attributes")),
    }
    return joined.withColumns(changed).select(*reads.columns)


def with_mates_fixed(reads: DataFrame, moves: DataFrame, read_groups: DataFrame) -> DataFrame:
    """Reads after ``with_moves`` whose mate has moved: mate_position follows, and inferred_size where both lie on one contig (kept else).

    Only fragments with a moved read are looked at. A mate is the other read of a name in a sample (first against second, primary lines only); of several deliveries of it the
    smallest id counts.
    """
    bare = F.regexp_replace("read_name", "/[12]$", "")
    first, second = F.col("flag").bitwiseAND(FLAG_FIRST) != 0, F.col("flag").bitwiseAND(FLAG_SECOND) != 0
    primary = F.col("flag").bitwiseAND(FLAG_SECONDARY | FLAG_SUPPLEMENTARY) == 0
    paired = with_sample(reads, read_groups, out="_sample").where(primary & (first != second))
    moved = paired.join(moves.select("record_id").distinct(), "record_id", "left_semi")
    end = F.col("contig_position") + C.reference_length(F.col("cigar")) - 1
    mate = F.struct(F.col("record_id").alias("id"), F.col("contig_position").alias("at"), end.alias("end"), contig_key(F.col("contig_name")).alias("contig"))
    news = moved.groupBy(F.coalesce("_sample", F.lit("")).alias("_s"), bare.alias("_name"), second.alias("_first")).agg(F.min(mate).alias("_mate"))
    keyed = with_sample(reads, read_groups, out="_sample").withColumns({"_k": F.coalesce("_sample", F.lit("")), "_bare": bare, "_is_first": F.when(primary & (first != second), first)})
    joined = keyed.join(news, (F.col("_k") == F.col("_s")) & (F.col("_bare") == F.col("_name")) & (F.col("_is_first") == F.col("_first")), "left")
    has = F.col("_mate").isNotNull()
    same = F.col("_mate.contig") == contig_key(F.col("contig_name"))
    left, right = F.least(F.col("contig_position"), F.col("_mate.at")), F.greatest(end, F.col("_mate.end"))
    sign = F.when(F.col("contig_position") <= F.col("_mate.at"), 1).otherwise(-1)
    changed = {"mate_position": F.when(has, F.col("_mate.at").cast("int")).otherwise(F.col("mate_position")), "inferred_size": F.when(has & same & F.col("inferred_size").isNotNull(), (sign * (right - left + 1)).cast("int")).otherwise(F.col("inferred_size"))}
    return joined.withColumns(changed).select(*reads.columns)


__all__ = ["known_events", "realigned", "with_mates_fixed", "with_moves"]
