"""Alignment kernels on one or two sequences: affine local alignment, the pair HMM, and base alignment quality."""

from __future__ import annotations

import math

import numpy as np

#: Fixed values: (match, mismatch, gap open, gap extend) for haplotypes against the reference, for dangling ends, and for realignment.
HAPLOTYPE_COSTS, DANGLING_COSTS, REALIGN_COSTS = (200, -150, -260, -11), (25, -50, -110, -6), (30, -10, -10, -2)
_NEG = -(10**9)


def compact(ops: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Equal neighbours merged, empty ones dropped."""
    out: list[tuple[str, int]] = []
    for op, n in ops:
        if n <= 0:
            continue
        if out and out[-1][0] == op:
            out[-1] = (op, out[-1][1] + n)
        else:
            out.append((op, n))
    return out


def cigar_text(ops: list[tuple[str, int]]) -> str:
    return "".join(f"{n}{op}" for op, n in compact(ops))


def smith_waterman(ref: str, query: str, costs: tuple[int, int, int, int] = HAPLOTYPE_COSTS, overhang: str = "softclip") -> tuple[int, list[tuple[str, int]], int]:
    """(offset in ref, operations, score) of the best alignment of ``query``.

    overhang: ``softclip`` clips what the best local alignment leaves of the query, ``indel`` aligns both sequences to their ends, ``ignore``
    keeps the whole query and lets it hang over the reference's ends. Rows are filled with numpy; a gap in the query direction is a running
    maximum of (score + extension so far), which turns the recurrence along a row into an accumulate.
    """
    match, mismatch, opening, extend = costs
    r, q = np.frombuffer(ref.encode(), np.uint8), np.frombuffer(query.encode(), np.uint8)
    n, m = len(r), len(q)
    local, whole = overhang == "softclip", overhang == "indel"
    best = np.zeros((n + 1, m + 1), np.int64)
    down = np.full((n + 1, m + 1), _NEG, np.int64)  # ends in a deletion
    across = np.full((n + 1, m + 1), _NEG, np.int64)  # ends in an insertion
    if whole:
        steps = np.arange(1, max(n, m) + 1)
        best[1:, 0] = opening + extend * (steps[:n] - 1)
        best[0, 1:] = opening + extend * (steps[:m] - 1)
        down[1:, 0], across[0, 1:] = best[1:, 0], best[0, 1:]
    columns = np.arange(m + 1) * extend
    for i in range(1, n + 1):
        diagonal = best[i - 1, :-1] + np.where(q == r[i - 1], match, mismatch)
        down[i, 1:] = np.maximum(best[i - 1, 1:] + opening, down[i - 1, 1:] + extend)
        base = np.maximum(diagonal, down[i, 1:])
        if local:
            base = np.maximum(base, 0)
        row = np.concatenate([[best[i, 0]], base])
        # across[j] = max over k < j of row[k] + opening + (j - k - 1) * extend; chaining gaps can't be better than one.
        reach = np.maximum.accumulate(row - columns)
        across[i, 1:] = reach[:-1] + columns[1:] + opening - extend
        best[i, 1:] = np.maximum(base, across[i, 1:])
    if whole:
        i, j = n, m
    elif local:
        i, j = (int(x) for x in np.unravel_index(int(best.argmax()), best.shape))
    else:
        last_row, last_column = best[n, :], best[:, m]
        i, j = (n, int(last_row.argmax())) if last_row.max() > last_column.max() else (int(last_column.argmax()), m)
    score = int(best[i, j])
    ops: list[tuple[str, int]] = []
    if j < m:
        ops.append(("S" if local else "I" if whole else "M", m - j))
    while i > 0 and j > 0 and not (local and best[i, j] == 0):
        here = best[i, j]
        if here == best[i - 1, j - 1] + (match if r[i - 1] == q[j - 1] else mismatch):
            ops.append(("M", 1))
            i, j = i - 1, j - 1
        elif here == down[i, j]:
            length = next(k for k in range(1, i + 1) if best[i - k, j] + opening + (k - 1) * extend == here)
            ops.append(("D", length))
            i -= length
        else:
            length = next(k for k in range(1, j + 1) if best[i, j - k] + opening + (k - 1) * extend == here)
            ops.append(("I", length))
            j -= length
    if j > 0:
        ops.append(("S" if local else "I" if whole else "M", j))
    if whole and i > 0:
        ops.append(("D", i))
        i = 0
    return i if not (overhang == "ignore" and j) else i - j, compact(ops[::-1]), score


def _known_alignment(ref: str, query: str, costs: tuple[int, int, int, int]) -> tuple[int, list[tuple[str, int]] | None]:
    """(length of the common end, operations before it where one alignment is known to be the best).

    A common end is always aligned as it is: equal last bases can be matched without loss, and ties are traced that way. Before it, one gap and
    else only matches can't be beaten, nor can so few mismatches between equal lengths that two gaps cost more.
    """
    match, mismatch, opening, extend = costs
    n, m = len(ref), len(query)
    if ref == query:
        return n, []
    tail = 0
    while tail < min(n, m) and ref[n - 1 - tail] == query[m - 1 - tail]:
        tail += 1
    r, q = ref[: n - tail], query[: m - tail]
    n, m = len(r), len(q)
    if match > 0 > opening and mismatch < 0 and opening <= extend <= 0:
        if r.startswith(q):
            return tail, [("M", m), ("D", n - m)]
        if q.startswith(r):
            return tail, [("M", n), ("I", m - n)]
        if n == m and sum(a != b for a, b in zip(r, q, strict=True)) * (match - mismatch) < match - 2 * opening:
            return tail, [("M", n)]
    return tail, None


def _traced(best: np.ndarray, down: np.ndarray, r: np.ndarray, q: np.ndarray, costs: tuple[int, int, int, int]) -> list[tuple[str, int]]:
    """Operations of a whole alignment from its matrices, as ``smith_waterman`` traces them."""
    match, mismatch, opening, extend = costs
    i, j, ops = len(r), len(q), []
    while i > 0 and j > 0:
        here = best[i, j]
        if here == best[i - 1, j - 1] + (match if r[i - 1] == q[j - 1] else mismatch):
            ops.append(("M", 1))
            i, j = i - 1, j - 1
        elif here == down[i, j]:
            length = next(k for k in range(1, i + 1) if best[i - k, j] + opening + (k - 1) * extend == here)
            ops.append(("D", length))
            i -= length
        else:
            length = next(k for k in range(1, j + 1) if best[i, j - k] + opening + (k - 1) * extend == here)
            ops.append(("I", length))
            j -= length
    return [("D", i), ("I", j), *ops[::-1]]


def whole_alignments(pairs: list[tuple[str, str]], costs: tuple[int, int, int, int] = HAPLOTYPE_COSTS, cells: int = 1 << 20) -> list[list[tuple[str, int]]]:
    """Operations of ``smith_waterman`` with the overhang ``indel`` for many pairs (ref, query). Matrices of pairs of like size, of about so many cells in all, are filled together."""
    match, mismatch, opening, extend = costs
    out: list[list[tuple[str, int]]] = []
    left = []
    for at, (ref, query) in enumerate(pairs):
        tail, ops = _known_alignment(ref, query, costs)
        out.append(compact([*(ops or []), ("M", tail)]))
        if ops is None:
            left.append((len(ref) - tail, len(query) - tail, at))
    left.sort()
    while left:
        n, m, size = 0, 0, 0
        while size < len(left) and (not size or (size + 1) * (max(n, left[-1 - size][0]) + 1) * (max(m, left[-1 - size][1]) + 1) <= cells):
            n, m, size = max(n, left[-1 - size][0]), max(m, left[-1 - size][1]), size + 1
        chunk, left = left[len(left) - size :], left[: len(left) - size]
        r = _padded([pairs[at][0][:a].encode() for a, _, at in chunk])
        q = _padded([pairs[at][1][:b].encode() for _, b, at in chunk])
        best = np.zeros((n + 1, size, m + 1), np.int32)
        down = np.full((n + 1, size, m + 1), _NEG, np.int32)
        steps = np.arange(max(n, m))
        best[1:, :, 0] = (opening + extend * steps[:n])[:, None]
        best[0, :, 1:] = opening + extend * steps[:m]
        down[1:, :, 0] = best[1:, :, 0]
        columns = (np.arange(m + 1) * extend).astype(np.int32)
        for i in range(1, n + 1):
            np.maximum(best[i - 1, :, 1:] + np.int32(opening), down[i - 1, :, 1:] + np.int32(extend), out=down[i, :, 1:])
            row = best[i]
            np.maximum(best[i - 1, :, :-1] + np.where(q == r[:, i - 1 : i], np.int32(match), np.int32(mismatch)), down[i, :, 1:], out=row[:, 1:])
            reach = np.maximum.accumulate(row - columns, axis=1)
            np.maximum(row[:, 1:], reach[:, :-1] + columns[1:] + np.int32(opening - extend), out=row[:, 1:])
        for b, (a, c, at) in enumerate(chunk):
            out[at] = compact([*_traced(best[:, b], down[:, b], r[b, :a], q[b, :c], costs), *out[at]])
    return out


def whole_alignment(ref: str, query: str, costs: tuple[int, int, int, int] = HAPLOTYPE_COSTS) -> list[tuple[str, int]]:
    """``whole_alignments`` of one pair."""
    return whole_alignments([(ref, query)], costs)[0]


def _padded(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), max(map(len, texts), default=0)), np.uint8)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = np.frombuffer(t, np.uint8)
    return out


def _pairs(x: np.ndarray, e: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, insertion: int, deletion: int, continuation: int) -> np.ndarray:
    gi, gd, gc = 10.0 ** (insertion / -10), 10.0 ** (deletion / -10), 10.0 ** (continuation / -10)
    mm, gm = 1 - gi - gd, 1 - gc
    size, longest, width = len(n), int(m.max()), x.shape[1] + 1
    scale = 2.0**1020
    start = scale / m
    rows = np.arange(size)
    total = np.zeros(size)
    # Read position first, so that what is taken of a diagonal is one piece of memory.
    x, right, wrong, y = (np.ascontiguousarray(v.T) for v in (x, 1 - e, e / 3, y[:, ::-1]))
    height = len(y)
    unknown_x, unknown_y = x == 78, y == 78
    some = bool(unknown_x.any() or unknown_y.any())
    # Antidiagonals before last (2), last (1) and now (0), by read position; position 0 is before the read, where it may begin anywhere.
    m2, i2, d2, m1, i1, d1, m0, i0, d0 = (np.zeros((width, size)) for _ in range(9))
    d1[0] = start
    for s in range(1, int(n.max()) + longest + 1):
        d0[0] = np.where(s <= m, start, 0.0)
        lo, hi = max(1, s - longest), min(width - 1, s - 1)
        for v in (m0, i0, d0):
            v[max(1, lo - 1) : lo] = 0.0  # held the diagonal three before
        if lo <= hi:
            a, b = x[lo - 1 : hi], y[height - s + lo : height - s + hi + 1]
            same = a == b
            if some:
                same |= unknown_x[lo - 1 : hi] | unknown_y[height - s + lo : height - s + hi + 1]
            into = i2[lo - 1 : hi] + d2[lo - 1 : hi]
            into *= gm
            into += m2[lo - 1 : hi] * mm
            np.multiply(np.where(same, right[lo - 1 : hi], wrong[lo - 1 : hi]), into, out=m0[lo : hi + 1])
            np.multiply(m1[lo - 1 : hi], gi, out=i0[lo : hi + 1])
            i0[lo : hi + 1] += i1[lo - 1 : hi] * gc
            np.multiply(m1[lo : hi + 1], gd, out=d0[lo : hi + 1])
            d0[lo : hi + 1] += d1[lo : hi + 1] * gc
        ended = np.flatnonzero((s > n) & (s - n <= m))
        if len(ended):
            total[ended] += m0[n[ended], rows[ended]] + i0[n[ended], rows[ended]]
        m2, i2, d2, m1, i1, d1, m0, i0, d0 = m1, i1, d1, m0, i0, d0, m2, i2, d2
    with np.errstate(divide="ignore"):
        return np.log10(total) - math.log10(scale)


def pair_hmm_matrices(blocks: list[tuple[list[str], list[list[int]], list[str]]], insertion: int = 45, deletion: int = 45, continuation: int = 10, chunk: int = 256) -> list[np.ndarray]:
    """log10 likelihood of each read (rows) given each haplotype (columns) of each block (reads, quals, haplotypes), summed over all alignments; a read may begin and end anywhere.

    Cells of one antidiagonal depend only on the two before it, so one numpy step fills it for a whole chunk of pairs of like size, of whatever blocks.
    Values are scaled by a power of two against underflow.
    """
    outs = []
    reads = [r for block in blocks for r in block[0]]
    quals = [q for block in blocks for q in block[1]]
    haplotypes = [h for block in blocks for h in block[2]]
    n, m = np.array([len(r) for r in reads], np.int64), np.array([len(h) for h in haplotypes], np.int64)
    pairs, begun = [], [0, 0]
    for own, _, texts in blocks:
        out = np.zeros((len(own), len(texts)))
        i, j = np.divmod(np.arange(out.size), max(1, len(texts)))
        pairs.append(np.stack([np.full(out.size, len(outs)), i, j, i + begun[0], j + begun[1]]))
        begun = [begun[0] + len(own), begun[1] + len(texts)]
        outs.append(out)
    block, i, j, read, haplotype = np.concatenate(pairs, axis=1) if pairs else np.zeros((5, 0), np.int64)
    score = np.where(n[read] == 0, 0.0, -math.inf) if len(read) else np.zeros(0)
    left = np.flatnonzero((n[read] > 0) & (m[haplotype] > 0)) if len(read) else np.zeros(0, np.int64)
    left = left[np.lexsort((n[read[left]], m[haplotype[left]]))]
    for at in range(0, len(left), chunk):
        p = left[at : at + chunk]
        own, other = read[p], haplotype[p]
        x, y = _padded([reads[k].encode() for k in own]), _padded([haplotypes[k].encode() for k in other])
        e = np.ones(x.shape)
        for row, k in zip(e, own, strict=True):
            row[: len(quals[k])] = 10.0 ** (np.asarray(quals[k], float) / -10.0)
        score[p] = _pairs(x, e, n[own], y, m[other], insertion, deletion, continuation)
    if len(score):
        edges = np.searchsorted(block, np.arange(len(outs) + 1))
        for k, out in enumerate(outs):
            out[i[edges[k] : edges[k + 1]], j[edges[k] : edges[k + 1]]] = score[edges[k] : edges[k + 1]]
    return outs


def pair_hmm_matrix(reads: list[str], quals: list[list[int]], haplotypes: list[str], insertion: int = 45, deletion: int = 45, continuation: int = 10, chunk: int = 256) -> np.ndarray:
    """``pair_hmm_matrices`` of one block."""
    return pair_hmm_matrices([(reads, quals, haplotypes)], insertion, deletion, continuation, chunk)[0]


def pair_hmm(read: str, quals: list[int], haplotype: str, insertion: int = 45, deletion: int = 45, continuation: int = 10) -> float:
    """One cell of ``pair_hmm_matrix``."""
    return float(pair_hmm_matrix([read], [quals], [haplotype], insertion, deletion, continuation)[0, 0])


def base_alignment_quality(read: str, quals: list[int], ref: str, expected: int, band: int = 7, gap_open: float = 1e-4, gap_extend: float = 0.1) -> list[int]:
    """Per base: the phred-scaled chance that it isn't aligned where an ungapped read starting at ``expected`` in ``ref`` has it, capped by its quality.

    Forward and backward sums of a three-state model inside a band around that diagonal, each row scaled to sum to 1.
    """
    n, m = len(read), len(ref)
    offsets = np.arange(-band, band + 1)
    e = 10.0 ** (np.asarray(quals, float) / -10.0)
    stay = 1 - 2 * gap_open
    width = len(offsets)

    def emission(i: int) -> np.ndarray:
        at = expected + i + offsets
        inside = (at >= 0) & (at < m)
        letters = np.array([ref[p] if ok else "-" for p, ok in zip(at.tolist(), inside.tolist(), strict=True)])
        p = np.where((letters == read[i]) & (letters != "N"), 1 - e[i], e[i] / 3)
        p[(letters == "N") | (read[i] == "N")] = 1.0
        p[~inside] = 0.0
        return p

    emissions = [emission(i) for i in range(n)]
    # States at read base i and band column b: M (aligned), I (inserted). Deletions move between columns before the next aligned base.
    jump = np.where(offsets[None, :] > offsets[:, None], gap_open * gap_extend ** np.maximum(offsets[None, :] - offsets[:, None] - 1, 0) * (1 - gap_extend), 0.0)
    move = np.eye(width) * stay + jump  # from M at column a to M at column b one base later
    forward_m, forward_i = np.zeros((n, width)), np.zeros((n, width))
    forward_m[0] = emissions[0] / width
    forward_m[0] /= max(forward_m[0].sum(), 1e-300)
    shift = lambda v: np.append(v[1:], 0.0)  # noqa: E731  an inserted base stays at its reference position: one column down
    for i in range(1, n):
        forward_m[i] = emissions[i] * (forward_m[i - 1] @ move + forward_i[i - 1] * (1 - gap_extend))
        forward_i[i] = 0.25 * shift(forward_m[i - 1] * gap_open + forward_i[i - 1] * gap_extend)
        total = max(forward_m[i].sum() + forward_i[i].sum(), 1e-300)
        forward_m[i] /= total
        forward_i[i] /= total
    back_m, back_i = np.ones(width), np.ones(width)
    out = [0] * n
    up = lambda v: np.insert(v[:-1], 0, 0.0)
    for i in range(n - 1, -1, -1):
        joint_m, joint_i = forward_m[i] * back_m, forward_i[i] * back_i
        total = joint_m.sum() + joint_i.sum()
        here = joint_m[band] / total if total > 0 else 0.0
        out[i] = max(0, min(int(quals[i]), 99 if here >= 1 else round(-10 * math.log10(max(1 - here, 1e-10)))))
        if i:
            em = emissions[i] * back_m
            next_m = move @ em + gap_open * 0.25 * up(back_i)
            next_i = (1 - gap_extend) * em + gap_extend * 0.25 * up(back_i)
            total = max(next_m.max(), next_i.max(), 1e-300)
            back_m, back_i = next_m / total, next_i / total
    return out


def left_aligned(ref: str, alt: str, before: str) -> tuple[int, str, str]:
    """(bases moved left, ref, alt) of an indel shifted left as long as the sequence before it allows; alleles keep a base in front."""
    moved = 0
    while before and ref and alt and ref[-1] == alt[-1] and (len(ref) == 1 or len(alt) == 1 or ref[0] == alt[0]) and len(ref) != len(alt):
        base = before[-1]
        ref, alt, before, moved = base + ref[:-1], base + alt[:-1], before[:-1], moved + 1
    return moved, ref, alt
