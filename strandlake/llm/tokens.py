"""Sizes of texts in tokens of a public tokenizer.

The vocabulary's folder and file are parameters; nothing of it is kept here. Texts are counted whole. A null text has no tokens.
"""

from __future__ import annotations

import ast
import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.session import tokenizer_dir

VOCABULARY = "byte_bpe_50k.tiktoken"


class _Counter:
    """A tokenizer, and the same merges over whole texts without the pattern that splits them."""

    def __init__(self, folder: str, vocabulary: str):
        import tiktoken

        with open(f"{folder}/{vocabulary}", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding(vocabulary, pat_str=_pattern(folder), mergeable_ranks=ranks, special_tokens={})
        self.encode_ordinary = self.plain.encode_ordinary
        self._make_whole = lambda: tiktoken.Encoding(vocabulary + "-whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self._whole = None

    def encode_piece(self, piece: str) -> list[int]:
        if self._whole is None:
            self._whole = self._make_whole()
        return self._whole.encode_ordinary(piece)


def _pattern(folder: str) -> str:
    """The splitting pattern, a string literal in the folder's description; read as data, not run."""
    with open(f"{folder}/__init__.py", encoding="utf-8") as description:
        for node in ast.parse(description.read()).body:
            if isinstance(node, ast.Assign) and [getattr(t, "id", None) for t in node.targets] == ["PATTERN"]:
                return ast.literal_eval(node.value)
    raise ValueError(f"{folder} names no PATTERN")


def _encoding(folder: str, vocabulary: str) -> _Counter:
    """The tokenizer, built once per Python worker."""
    import tiktoken

    held = tiktoken.__dict__.setdefault("_strandlake_encodings", {})
    if (folder, vocabulary) not in held:
        held[folder, vocabulary] = _Counter(folder, vocabulary)
    return held[folder, vocabulary]


#: White space as the pattern knows it, in runs too long for the pattern's lookahead.
_LONG_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")


def count_tokens(text: str | None, encoding) -> int:
    """Tokens of the whole text.

    Of a run of white space the pattern keeps the last character for what follows and takes the others as one piece. Runs that would
    overflow its stack are cut in the same way here, so the count is the same.
    """
    if not text:
        return 0
    total, at = 0, 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding.encode_piece(text[run.start() : end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:] if at else text))


def token_counts(docs: DataFrame, kept: list[str], text: str = "text", vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """The columns ``kept`` and ``n_tokens``."""
    folder = folder or tokenizer_dir()
    chosen = docs.select(*kept, F.col(text).alias("_text"))
    schema = chosen.drop("_text").schema.add("n_tokens", T.LongType())

    def counted(batches):
        encoding = _encoding(folder, vocabulary)
        for batch in batches:
            sizes = [count_tokens(t.as_py(), encoding) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return chosen.mapInArrow(counted, schema)
