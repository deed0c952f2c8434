"""Compact forms of sequences and qualities as bytes: two bits per base, and delta plus canonical Huffman codes.

Parquet's own encodings serve tables; these are for the places where one record's bytes are what is kept.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np

_CODE = np.zeros(256, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i
_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def pack_bases(seq: str) -> bytes:
    """Length, places of bases that aren't A, C, G or T with their letters, then four bases per byte. Case is not kept."""
    data = np.frombuffer(seq.upper().encode("ascii"), np.uint8)
    other = np.flatnonzero(~np.isin(data, _LETTERS))
    codes = np.zeros(-(-len(data) // 4) * 4, np.uint8)
    codes[: len(data)] = _CODE[data]
    packed = (codes.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1).astype(np.uint8)
    return struct.pack("<II", len(data), len(other)) + other.astype("<u4").tobytes() + data[other].tobytes() + packed.tobytes()


def unpack_bases(data: bytes) -> str:
    n, k = struct.unpack_from("<II", data)
    other = np.frombuffer(data, "<u4", k, 8)
    letters = np.frombuffer(data, np.uint8, k, 8 + 4 * k)
    packed = np.frombuffer(data, np.uint8, -1, 8 + 5 * k)
    codes = (packed[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).reshape(-1)[:n]
    out = _LETTERS[codes].copy()
    out[other] = letters
    return out.tobytes().decode("ascii")


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code length of each symbol."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    lengths, tie = dict.fromkeys(counts, 0), len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            lengths[s] += 1
        heapq.heappush(heap, (a[0] + b[0], tie, a[2] + b[2]))
        tie += 1
    return lengths


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(code, length) of each symbol: shorter codes first, equal ones in the order of their symbols."""
    code, before, out = 0, 0, {}
    for length, symbol in sorted((n, s) for s, n in lengths.items()):
        code <<= length - before
        out[symbol] = (code, length)
        code, before = code + 1, length
    return out


def pack_qualities(quals: str) -> bytes:
    """Differences of neighbouring characters, Huffman coded; the code's lengths go in front."""
    values = np.frombuffer(quals.encode("latin-1"), np.uint8).astype(np.int16)
    deltas = np.diff(values, prepend=np.int16(0)).tolist()
    if not deltas:
        return struct.pack("<IH", 0, 0)
    lengths = code_lengths(Counter(deltas))
    codes = canonical(lengths)
    bits = "".join(format(c, f"0{n}b") for c, n in (codes[d] for d in deltas))
    body = int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")
    table = b"".join(struct.pack("<hB", s, n) for s, n in sorted(lengths.items()))
    return struct.pack("<IH", len(deltas), len(lengths)) + table + body


def unpack_qualities(data: bytes) -> str:
    n, k = struct.unpack_from("<IH", data)
    if not n:
        return ""
    lengths = dict(struct.unpack_from("<hB", data, 6 + 3 * i) for i in range(k))
    symbols = {(length, code): s for s, (code, length) in canonical(lengths).items()}
    bits = "".join(format(b, "08b") for b in data[6 + 3 * k :])
    out, at, value = [], 0, 0
    while len(out) < n:
        length = 1
        while (length, int(bits[at : at + length], 2)) not in symbols:
            length += 1
        value += symbols[length, int(bits[at : at + length], 2)]
        out.append(value)
        at += length
    return bytes(out).decode("latin-1")
