"""What recalibration knows of single reads: repeats around a base, indel errors, errors spread over uncertain stretches, colour space."""

from __future__ import annotations

#: Longest unit and largest number of a repeat; the mark of a certain base.
MAX_UNIT, MAX_REPEATS, CERTAIN = 8, 20, "@"
#: The colour of a step from one base to another.
COLOURS = {"AA": 0, "CC": 0, "GG": 0, "TT": 0, "AC": 1, "CA": 1, "GT": 1, "TG": 1, "AG": 2, "GA": 2, "CT": 2, "TC": 2, "AT": 3, "TA": 3, "CG": 3, "GC": 3}
_STEP = {(a[0], c): a[1] for a, c in COLOURS.items()}


def _forward(bases: str, unit: str, at: int) -> int:
    n, k = 0, len(unit)
    while bases.startswith(unit, at + n * k):
        n += 1
    return n


def _backward(bases: str, unit: str, end: int) -> int:
    """Copies of the unit that end before ``end``."""
    n, k = 0, len(unit)
    while end - (n + 1) * k >= 0 and bases.startswith(unit, end - (n + 1) * k):
        n += 1
    return n


def repeat_at(bases: str, offset: int, longest: int = MAX_UNIT, most: int = MAX_REPEATS) -> tuple[str, int]:
    """(unit, number) of the tandem repeat around a base: of the shortest unit that repeats after it, counted on both sides; else of the one that repeats up to it."""
    end = offset + 1
    behind = next((u for k in range(1, min(longest, end) + 1) if _backward(bases, u := bases[end - k : end], end) > 1), None)
    if end >= len(bases):
        unit = behind or bases[offset]
        return unit, min(most, _backward(bases, unit, end))
    ahead = next((u for k in range(1, min(longest, len(bases) - end) + 1) if _forward(bases, u := bases[end : end + k], end) > 1), None)
    if ahead is None and behind is not None and bases[end] != behind:
        # Nothing repeats after the base: its next base is the unit, with the copies of it on both sides.
        ahead = bases[end]
    unit = ahead or bases[end]
    return unit, min(most, _forward(bases, unit, end) + _backward(bases, unit, end))


def indel_flags(ops: list[tuple[str, int]], length: int, reverse: bool) -> tuple[list[int], list[int]]:
    """(insertion flag, deletion flag) of each base: set on the base that the event follows in the order of sequencing."""
    inserted, deleted, at = [0] * length, [0] * length, 0
    for op, n in ops:
        if op == "D":
            k = at if reverse else at - 1
            if 0 <= k < length:
                deleted[k] = 1
        elif op == "I":
            k = at + n if reverse else at - 1
            if 0 <= k < length:
                inserted[k] = 1
        at += n if op in "MIS=X" else 0
    return inserted, deleted


def fractional_errors(errors: list[int], certainty: str) -> list[float]:
    """Errors of each base; over a stretch of uncertain bases and its neighbours on both sides the errors are shared alike."""
    out, begin = [float(e) for e in errors], None

    def share(first: int, last: int) -> None:
        first = max(0, first - 1)
        each = sum(errors[first : last + 1]) / (last - first + 1)
        out[first : last + 1] = [each] * (last - first + 1)

    for i, mark in enumerate(certainty):
        if mark != CERTAIN:
            begin = i if begin is None else begin
        elif begin is not None:
            share(begin, i)
            begin = None
    if begin is not None:
        share(begin, len(errors) - 1)
    return out


def colour_bases(colours: str) -> str:
    """Bases that a colour string (a primer base, then digits) stands for; N from the first colour that is none on."""
    out, base = [], colours[:1]
    for c in colours[1:]:
        base = _STEP.get((base, int(c)), "N") if c in "0123" else "N"
        out.append(base)
    return "".join(out)


def colour_inconsistencies(bases: str, colours: str) -> list[int]:
    """1 for each base of a read (in the order of sequencing) that its colours don't give."""
    implied = colour_bases(colours)
    return [int(i >= len(implied) or b != implied[i]) for i, b in enumerate(bases)]
