"""Realignment of a target's reads around one indel: the consensus that lowers the sum of mismatching qualities most."""

from __future__ import annotations

import numpy as np

from strandlake.kernels.align import compact
from strandlake.kernels.reads import Read

#: Improvement (in tens of phred) that a consensus needs, and mismatch quality beyond the consensus.
MIN_LOD, BEYOND = 5.0, 99


def indel_of(read: Read) -> tuple[int, int, str] | None:
    """(last reference position before it, deleted bases, inserted text) of a read with exactly one indel."""
    at, i, found = read.start, 0, None
    for op, n in read.ops:
        if op in "ID":
            if found:
                return None
            found = (at - 1, n if op == "D" else 0, read.seq[i : i + n] if op == "I" else "")
        at += n if op in "MDN=X" else 0
        i += n if op in "MIS=X" else 0
    return found


def consensus(ref: str, ref_start: int, event: tuple[int, int, str]) -> str | None:
    """The reference with the event; null if it isn't wholly inside."""
    after, gone, new = event
    k = after - ref_start + 1
    if k < 1 or k + gone > len(ref):
        return None
    return ref[:k] + new + ref[k + gone :]


def mismatch_sums(seq: str, quals: str, target: str, offsets: np.ndarray) -> np.ndarray:
    """Sum of the qualities of mismatches for each offset of the read on the target, without gaps; bases beyond it cost ``BEYOND`` each."""
    s, q = np.frombuffer(seq.encode(), np.uint8), np.frombuffer(quals.encode("latin-1"), np.uint8).astype(np.int64) - 33
    t = np.frombuffer(target.encode(), np.uint8)
    places = offsets[:, None] + np.arange(len(s))
    inside = (places >= 0) & (places < len(t))
    letters = np.where(inside, t[np.clip(places, 0, max(0, len(t) - 1))], 0)
    wrong = (letters != s) & (letters != 78) & (s != 78)
    return np.where(inside, np.where(wrong, q, 0), BEYOND).sum(axis=1)


def letters_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("latin-1", "replace"), np.uint8)


def qualities_of(read: Read) -> np.ndarray:
    return letters_of(read.quals).astype(np.int64) - 33


def raw_mismatches(read: Read, ref: str, ref_start: int) -> int:
    """Mismatching qualities of the read as it is aligned; inserted bases count in full, clipped ones not at all."""
    total, at, i = 0, read.start - ref_start, 0
    seq, qual, whole = letters_of(read.seq), qualities_of(read), letters_of(ref)
    for op, n in read.ops:
        if op in "M=X":
            a = min(max(at, 0), at + n)
            b = max(a, min(at + n, len(whole)))
            own, there = seq[i + a - at : i + b - at], whole[a:b]
            total += BEYOND * (n - (b - a)) + int(qual[i + a - at : i + b - at][(own != there) & (there != 78) & (own != 78)].sum())
        elif op == "I":
            total += int(qual[i : i + n].sum())
        at += n if op in "MDN=X" else 0
        i += n if op in "MIS=X" else 0
    return total


def best_place(read: Read, target: str, ref_start: int) -> tuple[int, int]:
    """(offset, mismatching qualities) of the best place of a read on the whole consensus; of equal ones the nearest to where it is, then the first."""
    near = read.start - ref_start
    if 0 < len(read.seq) <= len(target) and read.seq.isascii() and target.isascii():  # no base lies beyond the consensus
        own, whole = letters_of(read.seq), letters_of(target)
        wrong = np.lib.stride_tricks.sliding_window_view(whole, len(own)) != own
        if (whole == 78).any():
            wrong &= np.lib.stride_tricks.sliding_window_view(whole != 78, len(own))
        exact = np.float32 if len(own) < 1 << 16 else np.float64  # sums are whole numbers
        sums = wrong.astype(exact) @ np.where(own == 78, 0, qualities_of(read)).astype(exact)
    else:
        sums = mismatch_sums(read.seq, read.quals, target, np.arange(0, max(0, len(target) - len(read.seq)) + 1))
    least = np.flatnonzero(sums == sums.min())
    at = int(least[np.argmin(np.abs(least - near))])
    return at, int(sums[at])


def placed(offset: int, length: int, event: tuple[int, int, str], ref_start: int) -> tuple[int, tuple[tuple[str, int], ...]]:
    """Start and CIGAR of a read at an offset of the consensus."""
    after, gone, new = event
    k = after - ref_start + 1  # consensus columns before the event
    if offset + length <= k:
        return ref_start + offset, (("M", length),)
    if offset >= k + len(new):
        return ref_start + offset - len(new) + gone, (("M", length),)
    before = max(0, k - offset)
    if new:
        inside = min(len(new) - max(0, offset - k), length - before)
        ops = compact([("M", before), ("I", inside), ("M", length - before - inside)])
        if not before:
            ops = compact([("S", inside), ("M", length - inside)])
        return ref_start + (offset if before else k), tuple(ops)
    if not before:
        return ref_start + offset + gone, (("M", length),)
    return ref_start + offset, tuple(compact([("M", before), ("D", gone), ("M", length - before)]))


def realigned(reads: list[Read], ref: str, ref_start: int, known: list[tuple[int, int, str]] = (), min_lod: float = MIN_LOD) -> tuple[float, dict[int, Read]]:
    """(LOD of the best consensus, changed reads by their place in the list); nothing changes below ``min_lod``."""
    plain = [r if not any(op in "SHN" for op, _ in r.ops) else None for r in reads]
    raw = [raw_mismatches(r, ref, ref_start) if r else 0 for r in plain]
    events = sorted({e for e in (*known, *(indel_of(r) for r in plain if r)) if e})
    best: tuple[float, dict[int, Read]] = (0.0, {})
    for event in events:
        target = consensus(ref, ref_start, event)
        if target is None:
            continue
        gain, changed = 0, {}
        for i, r in enumerate(plain):
            if r is None or not raw[i]:
                continue
            offset, cost = best_place(r, target, ref_start)
            if cost < raw[i]:
                gain += raw[i] - cost
                start, ops = placed(offset, len(r.seq), event, ref_start)
                changed[i] = Read(start, ops, r.seq, r.quals)
        if gain / 10 > best[0]:
            best = (gain / 10, changed)
    return best if best[0] >= min_lod else (best[0], {})
