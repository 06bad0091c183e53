"""Packing: documents are concatenated and cut into windows of WINDOW tokens; only the last window is short.

Two passes. The first tokenizes every document once and stores its ids in the reliable checkpoint folder; totals per
partition, a number each, give every partition its global offset by a prefix sum. The second walks each partition from
its offset and cuts at the multiples of WINDOW. A window that two partitions share consists of records from both, with
gapless offsets: no rows move.

Defined results. A null text is empty: its only token is the separator. Very long texts lie in many windows; their ids are
held in memory, one text at a time. Repeated rows and rows that share a doc_id are packed each on its own, in the order in
which the table is read. Other columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import cut, rest

WINDOW = 1024
SEPARATOR = 0
VOCABULARY = "byte_bpe_50k.json"
#: Words whose ids a worker remembers; when full, it forgets all and starts again.
REMEMBERED = 600_000
_ENCODERS: dict[str, Encoder] = {}
# A single blank between two visible characters of these blocks always starts a new piece for a byte-level BPE whose
# pattern takes " ?letters", " ?digits" and " ?others": texts are cut there, and each word is encoded once.
_VISIBLE = "!-~\u00a1-\u024f"
_PLAIN = re.compile(rf"[{_VISIBLE}](?:.*[{_VISIBLE}])?", re.S)
_BREAK = re.compile(rf"(?<=[{_VISIBLE}]) (?=[{_VISIBLE}])")


def cuts_at_words(tokenizer) -> bool:
    """Whether a tokenizer is a byte-level BPE that cuts texts by the usual pattern, unchanged, before all else."""
    before, model = tokenizer.pre_tokenizer, tokenizer.model
    cuts = type(before).__name__ == "ByteLevel" and not before.add_prefix_space and before.use_regex
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    plain = type(model).__name__ == "BPE" and not any(getattr(model, k, None) for k in odd)
    added = tokenizer.get_added_tokens_decoder().values()
    return bool(cuts and plain and tokenizer.normalizer is None and not any(t.lstrip or t.single_word or t.normalized for t in added))


class Encoder:
    """Ids of whole texts by a tokenizer file, with a bounded memory of words.

    A word of letters, with or without a blank before it, and full stops or commas behind are pieces of the pattern: the
    model gets the letters, each word once. Other new words go through the whole tokenizer. All that holds for a byte-level
    BPE with the usual pattern and without a normaliser; by any other file, whole texts go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = cuts_at_words(self.tokenizer)
        if not self.by_words:
            return
        self.model = self.tokenizer.model
        marks = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # A Latin-1 reading of the UTF-8 bytes to the characters by which the vocabulary writes bytes.
        self.bytes = {b: marks.pre_tokenize_str(chr(b))[0][0][-1] if b < 128 else None for b in range(256)}
        for b in range(128, 256):
            text = chr(b)
            first, second = marks.pre_tokenize_str(text)[0][0]
            raw = text.encode()
            self.bytes[raw[0]], self.bytes[raw[1]] = first, second
        self.bytes = {b: c for b, c in self.bytes.items() if c is not None}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_end = self._ids("\n")
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, blank: str, word: str) -> bytes:
        """Ids of a word that begins a piece of the pattern, with or without a blank before it."""
        stem = word.rstrip(".,")
        if not stem.isalpha():
            return self._ids(blank + word)
        # A stem that stands alone somewhere is remembered as a word, and nowhere else.
        key = blank + stem
        ids = self.stems.get(key) or (self.known.get(stem) if blank else None)
        if ids is None:
            written = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.bytes)
            ids = array("I", [t.id for t in self.model.tokenize("\u0120" + written if blank else written)]).tobytes()
            if not blank or len(stem) < len(word):
                self.stems[key] = ids
        if len(stem) == len(word):
            return ids
        tail = word[len(stem) :]
        if tail not in self.tails:
            if len(self.tails) > REMEMBERED:
                self.tails.clear()
            self.tails[tail] = self._ids(tail)
        return ids + self.tails[tail]

    def _word(self, blank: str, word: str) -> bytes:
        """The same for a word that may go on over single line ends, each of which is a piece."""
        if "\n" not in word:
            return self._piece(blank, word)
        lines = word.split("\n")
        if not all(map(_PLAIN.fullmatch, lines)):
            return self._ids(blank + word)
        return self._piece(blank, lines[0]) + b"".join(self.line_end + self._piece("", x) for x in lines[1:])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_words:
            return [self._ids(text) for text in texts]
        known, out = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
            self.stems.clear()
        for text in texts:
            if any(a in text for a in self.added):
                out.append(self._ids(text))
                continue
            words = text.split(" ")
            fresh = set(words[1:]).difference(known)
            if len(words) > 1 and not (_PLAIN.fullmatch(words[0]) and all(map(_PLAIN.fullmatch, fresh))):
                # Blanks that don't stand alone between visible characters: the text is cut at the others only.
                words = _BREAK.split(text)
                fresh = set(words[1:]).difference(known)
            for word in fresh:
                known[word] = self._word(" ", word)
            out.append(self._word("", words[0]) + b"".join(map(known.__getitem__, words[1:])))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _narrow(ids: bytes) -> bytes:
    """Ids of 32 bits as their width in bytes and, where they fit, half as many bytes."""
    wide = np.frombuffer(ids, "<u4")
    return b"\2" + wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else b"\4" + ids


def _wide(stored: bytes) -> bytes:
    return np.frombuffer(stored, "<u2", offset=1).astype("<u4").tobytes() if stored[0] == 2 else stored[1:]


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (the separator included, as _narrow() writes them) and doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(path or _vocabulary()).encode_all
        end = np.array([SEPARATOR], dtype="<u4").tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = [x + end for x in encode_all([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([_narrow(x) for x in ids], pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                    ["doc_id", "ids", "doc_tokens"],
                )
        rest()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids binary, doc_tokens long")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document in a window; `ids` holds the piece's ids if `with_ids`, else null."""
    tokens = cut(tokenize(docs, path))
    totals = tokens.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect()
    offsets, at = {}, 0
    for row in totals:
        offsets[row["part"]] = at
        at += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = offsets.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, packed, n in zip(*(c.to_pylist() for c in batch.columns)):
                ids = _wide(packed)
                start = 0
                while start < n:
                    length = min(n - start, window - at % window)
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(piece), n, at // window, at % window, piece if with_ids else None))
                    start, at, held = start + length, at + length, held + len(piece)
                if held > 16_000_000 or len(rows) > 100_000:
                    yield _pieces(rows)
                    rows, held = [], 0
            yield _pieces(rows)

    return tokens.select("doc_id", "ids", "doc_tokens").mapInArrow(run, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if n == "ids" else pa.int64()) for i, n in enumerate(names)], names)
