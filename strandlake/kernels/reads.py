"""Changes of one aligned read: walking its CIGAR, cutting, reverting clips, and mending overlapping mates.

A CIGAR is a list of (operation, length). Positions are 1-based on the reference, offsets 0-based in the read; H bases aren't in the sequence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache

from strandlake.kernels.align import cigar_text, compact

_PART = re.compile(r"(\d+)([MIDNSHP=X])")
EATS_REF, EATS_READ = frozenset("MDN=X"), frozenset("MIS=X")


@lru_cache(1 << 14)
def _parsed(cigar: str) -> tuple[tuple[str, int], ...]:
    return tuple((op, int(n)) for n, op in _PART.findall(cigar))


def parse(cigar: str) -> list[tuple[str, int]]:
    return list(_parsed(cigar))


def reference_length(ops: list[tuple[str, int]]) -> int:
    return sum(n for op, n in ops if op in EATS_REF)


def read_length(ops: list[tuple[str, int]]) -> int:
    return sum(n for op, n in ops if op in EATS_READ)


def columns(ops: list[tuple[str, int]]) -> list[str]:
    return [op for op, n in ops for _ in range(n)]


def cleaned(ops: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Without empty operations and without deletions at the ends of the aligned part."""
    ops = compact(ops)
    inner = [i for i, (op, _) in enumerate(ops) if op not in "DNSH"]
    if not inner:
        return [x for x in ops if x[0] in "SH"]
    lo, hi = inner[0], inner[-1]
    return compact([x for i, x in enumerate(ops) if lo <= i <= hi or x[0] in "SH"])


@dataclass(frozen=True)
class Read:
    start: int
    ops: tuple[tuple[str, int], ...]
    seq: str
    quals: str

    @classmethod
    def of(cls, start: int, cigar: str, seq: str, quals: str) -> Read:
        return cls(start, _parsed(cigar), seq, quals)

    @property
    def end(self) -> int:
        return self.start + reference_length(list(self.ops)) - 1

    @property
    def cigar(self) -> str:
        return cigar_text(list(self.ops)) or "*"


def reference_position(read: Read, offset: int) -> int | None:
    """Where on the reference a read base lies; null for inserted and clipped bases."""
    at, i = read.start, 0
    for op, n in read.ops:
        if op in EATS_READ:
            if i <= offset < i + n:
                return at + offset - i if op in EATS_REF else None
            i += n
        if op in EATS_REF:
            at += n
    return None


def read_offset(read: Read, position: int, after_gap: bool = True) -> int | None:
    """The read base at a reference position. Inside a deletion: the first base after it, or the last one before it."""
    at, i = read.start, 0
    for op, n in read.ops:
        if op in EATS_REF and at <= position < at + n:
            if op in EATS_READ:
                return i + position - at
            return (i if i < len(read.seq) else None) if after_gap else (i - 1 if i else None)
        at += n if op in EATS_REF else 0
        i += n if op in EATS_READ else 0
    return None


def cut(read: Read, left: int, right: int) -> Read:
    """Without ``left`` bases at the begin and ``right`` at the end of the sequence; they become hard clips, and the start follows."""
    n = len(read.seq)
    if left + right >= n:
        return Read(read.start, (), "", "")
    if left <= 0 and right <= 0:
        return read
    kept, i, at, start = [], 0, read.start, None
    for op, length in read.ops:
        if op == "H":
            continue
        take = length
        if op in EATS_READ:
            lo, hi = max(i, left), min(i + length, n - right)
            take = max(0, hi - lo)
            if take and start is None and op in EATS_REF:
                start = at + lo - i
            i += length
        elif not left < i < n - right:
            take = 0
        if take:
            kept.append((op, take))
        if op in EATS_REF:
            at += length
    hard = [sum(x for op, x in read.ops[:1] if op == "H") + max(0, left), sum(x for op, x in read.ops[-1:] if op == "H") + max(0, right)]
    ops = cleaned([("H", hard[0]), *kept, ("H", hard[1])])
    return Read(read.start if start is None else start, tuple(ops), read.seq[left : n - right], read.quals[left : n - right])


def without_soft_clips(read: Read) -> Read:
    ends = [x for x in read.ops if x[0] != "H"]
    left = ends[0][1] if ends and ends[0][0] == "S" else 0
    right = ends[-1][1] if len(ends) > 1 and ends[-1][0] == "S" else 0
    return cut(read, left, right)


def reverted_soft_clips(read: Read) -> Read:
    """Soft clips as aligned bases; the start moves left by the leading one, but not before the contig (what lies there is cut)."""
    ends = [i for i, x in enumerate(read.ops) if x[0] != "H"]
    if not ends:
        return read
    lead = read.ops[ends[0]][1] if read.ops[ends[0]][0] == "S" else 0
    out = replace(read, start=read.start - lead, ops=tuple(compact([("M" if op == "S" else op, n) for op, n in read.ops])))
    return cut(out, 1 - out.start, 0) if out.start < 1 else out


@lru_cache
def _up_to(threshold: int) -> str:
    """All qualities up to the threshold as text."""
    return "".join(map(chr, range(threshold + 34)))


def low_quality_ends(read: Read, threshold: int) -> tuple[int, int]:
    """How many bases at either end have a quality of at most the threshold."""
    low = _up_to(threshold)
    kept = read.quals.lstrip(low) if low else read.quals
    if not kept:
        return len(read.seq), 0
    return len(read.quals) - len(kept), len(kept) - len(kept.rstrip(low) if low else kept)


def clipped_ends(read: Read, threshold: int, write_n: bool = False) -> Read:
    left, right = low_quality_ends(read, threshold)
    if not write_n:
        return cut(read, left, right)
    n = len(read.seq)
    return replace(read, seq="N" * min(left, n) + read.seq[left : n - right] + "N" * min(right, n - left))


def clipped_to(read: Read, start: int, stop: int) -> Read:
    """Only what lies in [start, stop] on the reference."""
    if read.end < start or read.start > stop:
        return Read(read.start, (), "", "")
    left = read_offset(read, start, after_gap=True) if read.start < start else 0
    last = read_offset(read, stop, after_gap=False) if read.end > stop else len(read.seq) - 1
    if left is None or last is None or last < left:
        return Read(read.start, (), "", "")
    return cut(read, left, len(read.seq) - 1 - last)


def adaptor_boundary(start: int, end: int, mate_start: int | None, insert: int | None, is_reverse: bool, well_defined: bool) -> int | None:
    """The first position beyond the fragment: before the mate's start on the reverse strand, after the insert's end on the forward one."""
    if not well_defined or not insert or mate_start is None:
        return None
    return mate_start - 1 if is_reverse else start + abs(insert)


def without_adaptor(read: Read, boundary: int | None, is_reverse: bool) -> Read:
    if boundary is None or not read.start <= boundary <= read.end:
        return read
    return clipped_to(read, boundary + 1, read.end) if is_reverse else clipped_to(read, read.start, boundary - 1)


def _aligned(read: Read) -> list[tuple[int, int, int]]:
    """(position, offset, length) of the runs of aligned bases."""
    out, at, i = [], read.start, 0
    for op, n in read.ops:
        if op in EATS_REF and op in EATS_READ:
            out.append((at, i, n))
        at += n if op in EATS_REF else 0
        i += n if op in EATS_READ else 0
    return out


def mended_mates(first: Read, second: Read, cap: int = 20) -> tuple[str, str]:
    """Qualities of two overlapping mates: where both have the same base, capped; where they differ, 0."""
    q1, q2 = list(first.quals), list(second.quals)
    most, others = chr(33 + cap), _aligned(second)
    for a, i, n in _aligned(first):
        for b, j, m in others:
            lo, hi = max(a, b), min(a + n, b + m)
            for x, y in zip(range(i + lo - a, i + hi - a), range(j + lo - b, j + hi - b), strict=True):
                if first.seq[x] == second.seq[y]:
                    q1[x], q2[y] = min(q1[x], most), min(q2[y], most)
                else:
                    q1[x] = q2[y] = chr(33)
    return "".join(q1), "".join(q2)


def composed(first: list[tuple[str, int]], second: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """A to C from A to B and B to C, column by column: what the first skips of B the second can't align, and the other way round."""
    out, later = [], columns(second)
    j = 0
    for op in columns(first):
        if op == "I":  # a base of A that B doesn't have
            out.append(("I", 1))
            continue
        while j < len(later) and later[j] == "D":  # bases of C that B doesn't have
            out.append(("D", 1))
            j += 1
        after = later[j] if j < len(later) else "M"
        j += 1
        if op == "M":
            out.append((after, 1))
        elif after == "M":  # deleted from A, in C
            out.append(("D", 1))
    out += [("D", 1) for x in later[j:] if x == "D"]
    return compact(out)


def trimmed_to_reference(ops: list[tuple[str, int]], lo: int, hi: int) -> list[tuple[str, int]]:
    """The part over reference columns lo to hi (0-based, both in)."""
    out, at = [], 0
    for op in columns(ops):
        if lo <= at <= hi and (op in EATS_REF or at > lo):
            out.append((op, 1))
        at += op in EATS_REF
    return compact(out)


def repeat_unit(bases: str) -> str:
    """The shortest unit whose repeats make the text."""
    return next((bases[:n] for n in range(1, len(bases) + 1) if len(bases) % n == 0 and bases[:n] * (len(bases) // n) == bases), "")


def repeats_at(sequence: str, unit: str) -> int:
    """How often the unit stands at the begin, again and again."""
    n = 0
    while unit and sequence.startswith(unit, n * len(unit)):
        n += 1
    return n


def tandem_repeat(ref: str, alt: str, after: str) -> tuple[str, int, int] | None:
    """(unit, repeats on the reference, repeats with the alternate) of a simple indel, counted in what follows its first base; null if it isn't a repeat."""
    if not ref or not alt or ref[0] != alt[0] or min(len(ref), len(alt)) != 1 or len(ref) == len(alt):
        return None
    changed = max(ref, alt, key=len)[1:]
    unit = repeat_unit(changed)
    on_ref = repeats_at(ref[1:] + after, unit)
    on_alt = repeats_at(alt[1:] + after, unit)
    return (unit, on_ref, on_alt) if min(on_ref, on_alt) > 0 else None


def merged_mates(first: Read, second: Read) -> Read | None:
    """Two gapless mates that overlap as one read over both: of differing bases the better one with the difference of qualities, of equal ones the better quality; null for others."""
    if any(op != "M" for r in (first, second) for op, _ in r.ops) or first.end < second.start or second.end < first.start:
        return None
    lo, hi = min(first.start, second.start), max(first.end, second.end)
    seq, quals = [], []
    for at in range(lo, hi + 1):
        here = [(ord(r.quals[at - r.start]), r.seq[at - r.start]) for r in (first, second) if r.start <= at <= r.end]
        best, other = max(here), min(here)
        seq.append(best[1])
        quals.append(chr(best[0] if best[1] == other[1] else max(33, 33 + best[0] - other[0])))
    return Read(lo, (("M", hi - lo + 1),), "".join(seq), "".join(quals))


def trimmed_haplotype(text: str, ops: list[tuple[str, int]], start: int, first: int, last: int) -> str:
    """The bases of a haplotype (aligned from ``start``) over reference positions first to last; a deletion at an end is left out."""
    out, at, i = [], start, 0
    for op in columns(ops):
        if op in "MIS=X":
            if first <= at <= last and op != "S" and (op != "I" or at > first):
                out.append(text[i])
            i += 1
        at += op in EATS_REF
    return "".join(out)


def with_allele(ref: str, ref_start: int, position: int, ref_allele: str, alt: str) -> str | None:
    """The reference with an allele in place of its own; null where the reference has another."""
    k = position - ref_start
    return ref[:k] + alt + ref[k + len(ref_allele) :] if k >= 0 and ref[k : k + len(ref_allele)] == ref_allele else None


def low_quality_soft_clips(read: Read, least: int) -> Read:
    """Without soft-clipped bases under the quality at the outer ends of the clips, from the end inwards to the first better one."""
    left = right = 0
    ops = list(read.ops)
    lead = ops[0][1] if ops and ops[0][0] == "S" else 0
    trail = ops[-1][1] if len(ops) > 1 and ops[-1][0] == "S" else 0
    while left < lead and ord(read.quals[left]) - 33 < least:
        left += 1
    while right < trail and ord(read.quals[-1 - right]) - 33 < least:
        right += 1
    return cut(read, left, right) if left or right else read
