"""Alignments of many reads at once as flat arrays: one element per read and covered reference position."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_OPERATION = re.compile(r"(\d+)([MIDNSHP=X])")
OPS = "MIDNSHP=X"
_CODE = {op: i for i, op in enumerate(OPS)}
_EATS_REF = np.array([op in "MDN=X" for op in OPS], np.int64)
_EATS_READ = np.array([op in "MIS=X" for op in OPS], np.int64)
_SHOWN = np.array([op in "M=XD" for op in OPS])
M, INSERTION, DELETION, SOFT = _CODE["M"], _CODE["I"], _CODE["D"], _CODE["S"]


@dataclass
class Elements:
    """read: index of the read; position: on the reference; offset: in the read from 0 (for a deletion that of the base before it); next_op and prev_op: code of the operation after the last and before the first element of one, else -1."""

    read: np.ndarray
    position: np.ndarray
    offset: np.ndarray
    deletion: np.ndarray
    next_op: np.ndarray
    prev_op: np.ndarray


def operations(cigars: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(read, code, length) of every operation of the CIGARs, in order."""
    known: dict[str, tuple[list[int], list[int]]] = {}
    codes: list[int] = []
    lengths: list[int] = []
    counts = np.empty(len(cigars), np.int64)
    for i, text in enumerate(cigars):
        found = known.get(text)
        if found is None:
            pairs = _OPERATION.findall(text)
            found = known[text] = ([_CODE[op] for _, op in pairs], [int(n) for n, _ in pairs])
        codes += found[0]
        lengths += found[1]
        counts[i] = len(found[0])
    return np.repeat(np.arange(len(cigars)), counts), np.array(codes, np.int64), np.array(lengths, np.int64)


def _within(read: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Sum of the steps before each operation in its read."""
    before = np.cumsum(step) - step
    if not len(read):
        return before
    first = np.flatnonzero(np.r_[True, read[1:] != read[:-1]])
    return before - np.repeat(before[first], np.diff(np.r_[first, len(read)]))


def elements(cigars: list[str], starts: np.ndarray) -> Elements:
    read, code, length = operations(cigars)
    ref = starts[read] + _within(read, length * _EATS_REF[code])
    offset = _within(read, length * _EATS_READ[code])
    shown = np.flatnonzero(_SHOWN[code] & (length > 0))
    n = length[shown]
    op = np.repeat(shown, n)
    i = np.arange(len(op)) - np.repeat(np.cumsum(n) - n, n)
    deletion = code[op] == DELETION
    following, leading = np.full(len(code), -1), np.full(len(code), -1)
    if len(code) > 1:
        same = read[1:] == read[:-1]
        following[:-1], leading[1:] = np.where(same, code[1:], -1), np.where(same, code[:-1], -1)
    return Elements(read[op], ref[op] + i, np.where(deletion, offset[op] - 1, offset[op] + i), deletion, np.where(i == length[op] - 1, following[op], -1), np.where(i == 0, leading[op], -1))


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins, how long each is); a character is one byte whatever it is, a null text is empty."""
    texts = [t or "" for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8), np.cumsum(sizes) - sizes, sizes


def picked(data: tuple[np.ndarray, np.ndarray, np.ndarray], read: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The byte at an offset of each read's text; 0 outside of it."""
    flat, begins, sizes = data
    inside = (offset >= 0) & (offset < sizes[read])
    if not len(flat):
        return np.zeros(len(read), np.uint8)
    return np.where(inside, flat[np.where(inside, begins[read] + offset, 0)], 0)


def upper(letter: np.ndarray) -> np.ndarray:
    return np.where((letter >= 97) & (letter <= 122), letter - 32, letter)
