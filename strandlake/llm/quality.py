"""Per-document text statistics that tell prose from lists, tables and junk.

The own text of a message is measured line by line. Tables show in the vertical alignment of delimiters (the same number of delimiters, or
gaps that begin or end in the same columns, in neighbouring lines), lists in markers, periodic indentation and short lines whose
lengths follow each other closely (autocorrelation), junk in the lack of what all prose has: common words among its words, few
symbols. The document's verdict comes from one sum of all measures: the share of its lines and characters of such kinds, how it is laid out
(alignment, periodicity, autocorrelation) and how it is worded (common words, symbols, ends of lines, lengths of words).

Defined results: a null or empty text, or one without own lines, has zero statistics and is prose; repeated ids are measured each on their
own; texts are measured whole; an empty table yields no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.mail import own_lines

#: Frequent function words of English, German, French and Spanish.
COMMON_WORDS = frozenset(
    """
    the of and to in is that it was for on are as with be at this have from or had by not but what all were when we there an which if do will
    about them then so would has could my than been who let us you your me he she they i am before after because only every please
    der die das und ist den von zu mit sich des auf für im dem nicht ein eine es als auch werden aus hat dass sie nach wird bei sind noch wie war
    haben nur wir ich uns müssen können bitte dann schon
    le la les de et à un une est que qui dans du pour pas sur au ce par avec je ne nous vous il on si mais tu cette été
    el los las y en se no con por lo ha muy para del al esta fue hay que antes más también
    """.split()
)
LINE_KINDS = ("prose", "list", "table", "junk")
SCHEMA = T.StructType(
    [
        T.StructField("n_lines", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("mean_word_length", T.DoubleType()),
        T.StructField("symbol_share", T.DoubleType()),
        T.StructField("punctuated_line_share", T.DoubleType()),
        T.StructField("common_word_share", T.DoubleType()),
        T.StructField("delimiter_alignment", T.DoubleType()),
        T.StructField("indent_periodicity", T.DoubleType()),
        T.StructField("length_autocorrelation", T.DoubleType()),
        T.StructField("structured_line_share", T.DoubleType()),
        T.StructField("structured_char_share", T.DoubleType()),
        T.StructField("kind", T.StringType()),
    ]
)

_WORD = re.compile(r"[^\W\d_]+")
_MARKER = re.compile(r"\s*(?:[-*•+–·‣◦○▪►o»]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)]|\[[ xX]?\])\s+\S")
_ADDRESS = re.compile(r"\s*(?:[\w.+-]+@[\w-]+\.[\w.-]+|(?:https?|ftp)://\S+|www\.\S+)\s*$")
_KEY_VALUE = re.compile(r"\s*[\w][\w .'-]{0,30}\s?[:=]\s\S+(?: \S+)?\s*$")
_GAP = re.compile(r" {2,}")
_PIPE_RULE = re.compile(r"[\s|+:=_-]{5,}$")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()’«»¿¡-]")
#: A window of text with a smaller share of common words among its words isn't sentences (the looser one counts where nothing is laid out), and the most words of an item.
MIN_COMMON, MIN_COMMON_LOOSE, ITEM_WORDS = 0.2, 0.13, 4
#: Share of lines indented like the lines some steps above, and correlation of neighbouring line lengths, from which lines are laid out as items.
PERIODIC, CORRELATED = 0.75, 0.6
#: Weights of what a document's lines are, of its layout and of its wording in the verdict, and the value of each (0 as in prose, 1 its opposite) that
#: speaks for neither side. The lines alone decide where they are clear; the others where about half of a text is of other kinds.
WEIGHTS, NEUTRAL = {"lines": 1.0, "layout": 0.1, "wording": 0.3}, {"lines": 0.5, "layout": 0.1, "wording": 0.27}
#: Common words, symbols and mean word lengths from which wording counts as that of prose, or as its opposite.
USUAL_COMMON, MANY_SYMBOLS, USUAL_LENGTHS, CONSISTENT = 0.3, 0.1, (3.0, 6.5), 0.6


def _delimiters(line: str) -> tuple[dict[str, int], set[int], set[int]]:
    """Counts of cell delimiters, and the columns in which wide gaps begin and end."""
    counts = {d: n for d in "|\t;," if (n := line.count(d))}
    body = line.rstrip()
    starts, ends = set(), set()
    if "  " in body:
        for gap in _GAP.finditer(body):
            if gap.start():
                starts.add(gap.start())
            ends.add(gap.end())
    return counts, starts, ends


def _aligned(a, b) -> bool:
    """Neighbouring lines with the same delimiters, or with gaps in the same columns."""
    for d, n in a[0].items():
        if b[0].get(d) == n and n >= (1 if d == "\t" else 2):
            return True
    return bool(a[1] and b[1] and (len(a[1] & b[1]) * 2 >= min(len(a[1]), len(b[1])) or len(a[2] & b[2]) * 2 >= min(len(a[2]), len(b[2]))))


def _autocorrelation(values: list[int]) -> float:
    """Of neighbouring values; 1 if all are equal."""
    if len(values) < 3:
        return 0.0
    mean = sum(values) / len(values)
    spread = sum((v - mean) ** 2 for v in values)
    return sum((a - mean) * (b - mean) for a, b in zip(values, values[1:], strict=False)) / spread if spread else 1.0


def _periodicity(indents: list[int]) -> float:
    """The best share of lines indented as the line 1 to 4 above, where any are indented."""
    if len(indents) < 3 or not any(indents):
        return 0.0
    return max(sum(a == b for a, b in zip(indents, indents[k:], strict=False)) / (len(indents) - k) for k in range(1, min(5, len(indents))))


def line_kinds(lines: list[str]) -> tuple[list[str], list[list[str]], list[int], int]:
    """The kind of each line (none blank), its words, how many of them are common, and the number of aligned lines."""
    words = [_WORD.findall(x.lower()) for x in lines]
    common = [sum(w in COMMON_WORDS for w in ws) for ws in words]
    n = len(lines)
    delimited = [_delimiters(x) if "|" in x or "\t" in x or ";" in x or "," in x or "  " in x else None for x in lines]
    kinds = [""] * n
    aligned = 0
    indents = [len(x) - len(x.lstrip()) for x in lines]
    # Lines that are indented by a pattern or whose lengths follow each other are laid out as items.
    laid_out = _periodicity(indents) >= PERIODIC or abs(_autocorrelation([len(x.strip()) for x in lines])) >= CORRELATED
    for i, line in enumerate(lines):
        if delimited[i] and (i and delimited[i - 1] and _aligned(delimited[i], delimited[i - 1]) or i + 1 < n and delimited[i + 1] and _aligned(delimited[i], delimited[i + 1])):
            aligned += 1
            # Commas align by chance in sentences, which their common words give away.
            if common[i] < max(2, MIN_COMMON * len(words[i])):
                kinds[i] = "table"
                continue
        if _MARKER.match(line) or _ADDRESS.match(line):
            kinds[i] = "list"
    for i in range(n):
        if kinds[i]:
            continue
        # A line that announces what follows says nothing about it.
        near = [j for j in range(max(0, i - 2), min(n, i + 3)) if j == i or kinds[j] not in ("table", "list") and lines[j].rstrip()[-1] != ":"]
        n_words, n_common = sum(len(words[j]) for j in near), sum(common[j] for j in near)
        own = len(words[i])
        sentence = common[i] > 0 and own >= 3 and lines[i].rstrip()[-1] in ".!?" and common[i] >= MIN_COMMON / 2 * own
        if sentence or own >= 4 and common[i] >= MIN_COMMON * own or n_common and n_common >= MIN_COMMON * n_words and (own >= 6 or common[i] or own and n_common >= 4):
            kinds[i] = "prose"
        elif not laid_out and own >= ITEM_WORDS and n_common >= MIN_COMMON_LOOSE * n_words and lines[i][0].isalpha() and sum(map(len, words[i])) >= 0.7 * len(lines[i].strip()):
            kinds[i] = "prose"  # fewer common words than most, but nothing else it could be
        elif i and kinds[i - 1] == "table" or i + 1 < n and kinds[i + 1] == "table":
            kinds[i] = "table"
        elif lines[i][:1] in " \t" and (i and kinds[i - 1] == "list" or i + 1 < n and kinds[i + 1] == "list") or _KEY_VALUE.match(lines[i]):
            kinds[i] = "list"
        elif _PIPE_RULE.match(lines[i]) or not own:
            kinds[i] = "junk"
        elif own <= ITEM_WORDS or laid_out and indents[i] and own <= 2 * ITEM_WORDS:
            kinds[i] = "list"
        else:
            kinds[i] = "junk"
    return kinds, words, common, aligned


def measure(text: str | None) -> tuple:
    """The statistics of one document, in the order of ``SCHEMA``."""
    lines = [x for x in own_lines(text) if x.strip()] if text else []
    if not lines:
        return (0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "prose")
    kinds, words, common, aligned = line_kinds(lines)
    n_words = sum(map(len, words))
    chars = [len(x.strip()) for x in lines]
    size = {k: [0, 0] for k in LINE_KINDS}
    for kind, c in zip(kinds, chars, strict=True):
        size[kind][0] += 1
        size[kind][1] += c
    other = {k: v for k, v in size.items() if k != "prose"}
    line_share, char_share = sum(v[0] for v in other.values()) / len(lines), sum(v[1] for v in other.values()) / sum(chars)
    mean_length = sum(len(w) for ws in words for w in ws) / max(1, n_words)
    symbols = sum(len(_SYMBOL.findall(x)) for x in lines) / sum(chars)
    punctuated = sum(x.rstrip()[-1] in ".!?…:;," for x in lines) / len(lines)
    common_share = sum(common) / max(1, n_words)
    alignment, periodicity, correlation = aligned / len(lines), _periodicity([len(x) - len(x.lstrip()) for x in lines]), _autocorrelation(chars)
    layout = max(alignment, periodicity, min(1.0, max(0.0, correlation)))
    evidence = {"lines": min(line_share, char_share), "layout": layout, "wording": _wording(common_share, symbols, punctuated, mean_length)}
    kind = "prose"
    if sum(WEIGHTS[k] * (v - NEUTRAL[k]) for k, v in evidence.items()) > 0:
        weight = {k: v[1] for k, v in other.items()}
        if weight["table"] and _consistency([x for x, k in zip(lines, kinds, strict=True) if k == "table"]) < CONSISTENT:
            # Delimiters that agree here and there by chance: no columns.
            weight = weight | {"junk": weight["junk"] + weight["table"], "table": 0}
        kind = max(weight, key=lambda k: weight[k])
    return (len(lines), n_words, mean_length, symbols, punctuated, common_share, alignment, periodicity, correlation, line_share, char_share, kind)


def _wording(common: float, symbols: float, punctuated: float, mean_length: float) -> float:
    """How unlike prose the words are, from 0 to 1: the mean of four measures."""
    low, high = USUAL_LENGTHS
    odd_length = min(1.0, max(0.0, low - mean_length, mean_length - high) / low)
    return (1 - min(1.0, common / USUAL_COMMON) + min(1.0, symbols / MANY_SYMBOLS) + (1 - punctuated) + odd_length) / 4


def _consistency(lines: list[str]) -> float:
    """The largest share of lines with the same number of one delimiter, or with wide gaps."""
    delimited = [_delimiters(x) for x in lines]
    found = [sum(bool(x[2]) for x in delimited)]
    for d in "|\t;,":
        counts: dict[int, int] = {}
        for x in delimited:
            if n := x[0].get(d):
                counts[n] = counts.get(n, 0) + 1
        found += counts.values()
    return max(found) / len(lines)


def text_quality(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The document's id and its statistics."""
    from pyspark.sql.pandas.types import to_arrow_schema

    chosen = docs.select(F.col(doc), F.col(text).alias("_text"))
    schema = T.StructType([chosen.schema[doc], *SCHEMA.fields])
    arrow = to_arrow_schema(schema)

    def measured(batches):
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else ((),) * len(SCHEMA)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    return chosen.mapInArrow(measured, schema)
