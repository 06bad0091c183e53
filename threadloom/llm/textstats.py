"""Counts over one text, in one pass over its words and one over its code points."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from threadloom.llm.common import rest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"

FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_upper", "n_lower", "n_digit", "n_punct", "n_pipe", "n_wide", "n_codes",
)
SCHEMA = ", ".join(f"{f} long" for f in FIELDS)


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(129, dtype=np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_CLASSES = np.stack([
    _mask(SYMBOLS),
    _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _mask("abcdefghijklmnopqrstuvwxyz"),
    _mask("0123456789"),
    _mask("!\"'(),-./:;?[]`{}"),
    _mask("|"),
    np.eye(129, dtype=np.int64)[128],
])


def repeated_words(words: list[str]) -> int:
    """Words that stand in a 3-word window found at least twice; every occurrence counts, each word once."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    total, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == 1:
        return 0
    full = [x for x in lines if x.strip(" \t\n\x0b\f\r")]
    return len(full) - len(set(full))


def text_stats(text: str | None) -> tuple[int, ...]:
    """The FIELDS of a text; a null counts as an empty text, for which all but n_lines are 0."""
    text = text or ""
    words = WORDS.findall(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    histogram = np.bincount(np.minimum(codes, 128), minlength=129)
    symbols, upper, lower, digit, punct, pipe, wide = (int(x) for x in _CLASSES @ histogram)
    return (
        len(words), sum(map(len, words)), symbols, repeated_lines(text), repeated_words(words),
        text.count("\n") + 1, len(set(words)), upper, lower, digit, punct, pipe, wide, len(codes),
    )


def with_stats(keep: list[str], text: str = "text"):
    """A function for mapInArrow: the columns `keep` as they are, then the FIELDS of column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            columns += [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(FIELDS))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *FIELDS])
        rest()

    return run
