"""Loading of raw text records: every record comes out typed or rejected with its reason.

A record's text is assembled quote-aware (tabs and line ends inside quotes are data), split by Python's strict csv
reader inside mapInArrow, and only then handed to typed field constructors, so that a structural fault (quoting, column
count) is told apart from a bad value and neither stops the load.

Defined results: a null text is rejected as ``null_text``; an empty line or one that starts with ``#`` (VCF) is no record
and yields no row; an empty table yields an empty result; repeated rows are judged each on their own; texts may be of any
length; columns of the input other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import csv
import itertools
import re
from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VCF_ROW = T.StructType(
    [
        T.StructField("raw_id", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("contig_name", T.StringType()),
        T.StructField("contig_position", T.LongType()),
        T.StructField("variant_id", T.StringType()),
        T.StructField("ref_allele", T.StringType()),
        T.StructField("alts", T.ArrayType(T.StringType())),
        T.StructField("qual", T.DoubleType()),
        T.StructField("filters", T.StringType()),
        T.StructField("info", T.StringType()),
        T.StructField("format_keys", T.StringType()),
        T.StructField("genotype", T.StringType()),
    ]
)
FASTQ_ROW = T.StructType(
    [
        T.StructField("raw_id", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("read_name", T.StringType()),
        T.StructField("seq", T.StringType()),
        T.StructField("base_quals", T.StringType()),
    ]
)

_BASES = re.compile(r"[ACGTNacgtn]+")
_ALT = re.compile(r"[ACGTNacgtn]+|\*|<[A-Za-z][A-Za-z0-9_:]*>")
_QUAL = re.compile(r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_DIGITS = re.compile(r"[0-9]+")
_QUALITY = re.compile(r"[!-~]+")


class Rejected(Exception):
    """A fault of one record; its text is the reason."""


def contig_lengths(contigs: DataFrame, max_contigs: int = 1_000_000) -> dict[str, tuple[str, int]]:
    """The sequence dictionary as unified name -> (spelling, length).

    Its size is that of an assembly, not of the data; more than ``max_contigs`` rows are an error rather than a large broadcast.
    """
    rows = contigs.select("contig_name", "contig_length").limit(max_contigs + 1).collect()
    if len(rows) > max_contigs:
        raise ValueError(f"the sequence dictionary has more than {max_contigs} contigs")
    found: dict[str, tuple[str, int]] = {}
    for name, length in rows:
        if name is not None and length is not None:
            found.setdefault(bare_contig(name.strip()), (name, int(length)))
    return found


def bare_contig(name: str) -> str:
    bare = name[3:] if name[:3].lower() == "chr" else name
    return "MT" if bare == "M" else bare


#: Lines that a quoted field may go on over.
MAX_LINES = 1000


def assemble(lines: Iterable[str], delimiter: str = "\t", max_lines: int = MAX_LINES) -> Iterator[tuple[int, str]]:
    """(number of its first line from 0, text) of the records that physical lines hold: a line that ends inside an open quoted field goes on in the next one.

    A field is open if it starts with a quote and holds an odd number of quotes up to the line's end. Where it doesn't close within ``max_lines``, or
    where what it closes to is broken, its first line is a record of its own (which the parser rejects) and the lines after it are
    judged anew, so that one lost quote takes no other record with it.
    """
    source, ahead, at = iter(lines), deque(), 0
    while True:
        if not ahead:
            line = next(source, None)
            if line is None:
                return
            ahead.append(line)
        held = 1
        if '"' in ahead[0] and _ends_open(ahead[0], False, delimiter):
            held = _closing(ahead, source, delimiter, max_lines)
        yield at, "\n".join(ahead.popleft() for _ in range(held))
        at += held


def ends_open(line: str, delimiter: str = "\t") -> bool:
    """Whether a line that begins a record ends inside a quoted field."""
    return _ends_open(line, False, delimiter)


def closing(lines: Sequence[str], max_lines: int = MAX_LINES, delimiter: str = "\t") -> int:
    """How many of the lines make the record that the first one, which ends inside a quoted field, begins; 1 where it doesn't close soundly."""
    return _closing(deque(lines), iter(()), delimiter, max_lines)


def _closing(ahead: deque, source: Iterator[str], delimiter: str, max_lines: int) -> int:
    """How many lines the record at the head of ``ahead`` has; lines are drawn from ``source`` as needed."""
    is_open, n = True, 1
    while is_open and n < max_lines:
        if n == len(ahead):
            line = next(source, None)
            if line is None:
                return 1
            ahead.append(line)
        is_open = _ends_open(ahead[n], True, delimiter)
        n += 1
    if is_open:
        return 1
    try:
        split_record("\n".join(itertools.islice(ahead, n)), delimiter)
    except Rejected:
        return 1
    return n


def _ends_open(line: str, is_open: bool, delimiter: str) -> bool:
    at = 0
    while True:
        if is_open:
            closing = line.find('"', at)
            while closing >= 0 and line[closing + 1 : closing + 2] == '"':
                closing = line.find('"', closing + 2)
            if closing < 0:
                return True
            is_open, at = False, closing + 1
        elif line[at : at + 1] == '"' and (at == 0 or line[at - 1] == delimiter):
            is_open, at = True, at + 1
            continue
        following = line.find(delimiter, at)
        if following < 0:
            return False
        at = following + 1


def _absent(text: str, taken: str = "") -> str:
    """A character of the private area that the text doesn't hold."""
    return next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in text and chr(c) not in taken)


def _strict_fields(text: str, delimiter: str, quoted: bool) -> list[str]:
    """The fields as Python's strict csv reader sees them; line ends are data here, where the reader would end the record."""
    if not text:
        return [""]
    swaps: list[tuple[str, str]] = []
    for end in ("\r", "\n", "\0"):
        if end in text and end != delimiter:
            swaps.append((end, _absent(text, "".join(s for _, s in swaps))))
    for end, stand_in in swaps:
        text = text.replace(end, stand_in)
    if delimiter == "\n":  # the reader takes no line end as a delimiter
        delimiter = _absent(text, "".join(s for _, s in swaps))
        text = text.replace("\n", delimiter)
    if len(text) > 1 << 17:
        csv.field_size_limit(max(len(text), csv.field_size_limit()))  # no field is too long
    try:
        if quoted:
            (fields,) = csv.reader((text,), delimiter=delimiter, quotechar='"', doublequote=True, strict=True)
        else:
            (fields,) = csv.reader((text,), delimiter=delimiter, quoting=csv.QUOTE_NONE, quotechar=None, strict=True)
    except (csv.Error, ValueError) as fault:
        raise Rejected("quote") from fault
    for end, stand_in in swaps:
        fields = [v.replace(stand_in, end) for v in fields]
    return fields


def split_record(text: str, delimiter: str = "\t") -> list[str]:
    """The fields of one record; raises ``Rejected('quote')`` for broken quoting.

    The strict reader faults quotes that never close or are followed by other text. It lets a quote inside an unquoted field pass,
    so the fields of a text with quotes are laid over it once more: an unquoted one may not hold a quote.
    """
    fields = _strict_fields(text, delimiter, quoted=True)
    if '"' not in text:
        return fields
    at = 0
    for value in fields:
        quotes = value.count('"')
        if text[at : at + 1] == '"':
            at += len(value) + quotes + 2
        elif quotes:
            raise Rejected("quote")
        else:
            at += len(value)
        at += 1
    return fields


def _position(text: str, length: int) -> int:
    if not _DIGITS.fullmatch(text):
        raise Rejected("position")
    digits = text.lstrip("0")
    if not digits or len(digits) > 18 or int(digits) > length:
        raise Rejected("position")
    return int(digits)


def _alts(text: str, ref: str) -> list[str]:
    if text == ".":
        return []
    items, seen = text.split(","), {ref.upper()}
    for item in items:
        if not _ALT.fullmatch(item):
            raise Rejected("alt")
        if item.upper() in seen:
            raise Rejected("alt_repeated")
        seen.add(item.upper())
    return items


def vcf_record(text: str, contigs: dict[str, tuple[str, int]]) -> tuple:
    """The typed fields of one VCF line, or ``Rejected``."""
    fields = split_record(text)
    if len(fields) not in (8, 10):
        raise Rejected("field_count")
    if not all(fields):
        raise Rejected("empty_field")
    known = contigs.get(bare_contig(fields[0]))
    if known is None:
        raise Rejected("contig")
    position = _position(fields[1], known[1])
    if not _BASES.fullmatch(fields[3]):
        raise Rejected("ref")
    alts = _alts(fields[4], fields[3])
    if fields[5] != "." and not _QUAL.fullmatch(fields[5]):
        raise Rejected("qual")
    qual = None if fields[5] == "." else float(fields[5])
    return (known[0], position, fields[2], fields[3], alts, qual, fields[6], fields[7], *(fields[8:] or (None, None)))


def fastq_record(text: str) -> tuple:
    """The typed fields of one FASTQ record, or ``Rejected``. Its lines are the fields, and the reader takes quotes as what they are here, quality values."""
    lines = _strict_fields(text, "\n", quoted=False)
    ended = lines[:-1] if lines[-1] == "" and len(lines) > 1 else None
    lines = [x.removesuffix("\r") for x in ended] if ended is not None else [*(x.removesuffix("\r") for x in lines[:-1]), lines[-1]]
    if len(lines) != 4:
        raise Rejected("line_count")
    head, seq, plus, quals = lines
    if head[:1] != "@" or len(head) < 2 or head[1] in " \t":
        raise Rejected("description")
    if not _BASES.fullmatch(seq):
        raise Rejected("sequence")
    if plus != "+" and plus != "+" + head[1:]:
        raise Rejected("separator")
    if not _QUALITY.fullmatch(quals):
        raise Rejected("quality")
    if len(quals) != len(seq):
        raise Rejected("quality_length")
    name = head[1:].split(" ", 1)[0]
    return (head[1:], name[:-2] if name[-2:] in ("/1", "/2") else name, seq, quals)


def _is_vcf_record(text: str | None) -> bool:
    return text is None or (text != "" and text[0] != "#")


def _mapped(raw: DataFrame, raw_id: str, text: str, parse, is_record, schema: T.StructType, kept: Sequence[str]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    chosen = raw.select(F.col(raw_id).cast("bigint").alias("_id"), F.col(text).alias("_text"), *(F.col(k).alias(f"_kept{i}") for i, k in enumerate(kept)))
    out = T.StructType([*schema.fields, *(T.StructField(k, f.dataType) for k, f in zip(kept, chosen.schema.fields[2:], strict=True))])
    arrow, width = to_arrow_schema(out), len(schema) - 2

    def parsed(batches):
        blank = (None,) * width
        for batch in batches:
            rows, places = [], []
            for place, (key, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if not is_record(value):
                    continue
                places.append(place)
                try:
                    if value is None:
                        raise Rejected("null_text")
                    rows.append((key, None, *parse(value)))
                except Rejected as fault:
                    rows.append((key, str(fault), *blank))
            columns = zip(*rows, strict=True) if rows else ((),) * (width + 2)
            own = [pa.array(list(c), type=f.type) for c, f in zip(columns, list(arrow)[: width + 2], strict=True)]
            carried = [c.take(pa.array(places, pa.int64())) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*own, *carried], schema=arrow)

    return chosen.mapInArrow(parsed, out)


def parse_vcf(raw: DataFrame, contigs: DataFrame, raw_id: str = "raw_id", text: str = "line_text", kept: Sequence[str] = ()) -> DataFrame:
    """One row per VCF record of ``raw``: typed fields, or nulls and a ``reason``; then the columns ``kept``."""
    known = contig_lengths(contigs)
    return _mapped(raw, raw_id, text, lambda t: vcf_record(t, known), _is_vcf_record, VCF_ROW, kept)


def parse_fastq(raw: DataFrame, raw_id: str = "raw_id", text: str = "record_text", kept: Sequence[str] = ()) -> DataFrame:
    """One row per FASTQ record of ``raw``: typed fields, or nulls and a ``reason``; then the columns ``kept``."""
    return _mapped(raw, raw_id, text, fastq_record, lambda _: True, FASTQ_ROW, kept)


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select("raw_id", "reason")
