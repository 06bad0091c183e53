"""Signed feature hashing of text to unit vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T

DIMENSIONS = 512


def _places(terms: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each term its dimension and its sign."""
    digests = b"".join(hashlib.blake2b(t.encode(), digest_size=16).digest() for t in terms)
    octets = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 16)
    return (octets[:, :8].copy().view(">u8").ravel() % dimensions).astype(np.int64), np.where(octets[:, 8] & 1, 1.0, -1.0)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a list column, and the elements."""
    lengths = np.diff(column.offsets.to_numpy()) * np.asarray(column.is_valid())
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


def _hashed(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    """Rows of unit vectors: title terms count twice, body terms and adjacent pairs of them once."""
    title_row, title = _lists(batch.column(1))
    body_row, body = _lists(batch.column(2))
    known = pa.concat_arrays([title, body]).dictionary_encode()
    words, at = known.dictionary.to_pylist(), known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own, said = at[: len(title)], at[len(title) :]
    # Each distinct term and each distinct pair is hashed once.
    together = np.flatnonzero(body_row[1:] == body_row[:-1]) if len(body_row) else np.empty(0, np.int64)
    codes, pair = np.unique(said[together] * len(words) + said[together + 1], return_inverse=True)
    place, sign = _places(words + [f"{words[c // len(words)]}::{words[c % len(words)]}" for c in codes.tolist()], dimensions)
    terms = np.concatenate([own, said, len(words) + pair])
    rows = np.concatenate([title_row, body_row, body_row[together]])
    twice = np.where(np.arange(len(terms)) < len(own), 2.0, 1.0)
    vectors = np.bincount(rows * dimensions + place[terms], weights=sign[terms] * twice, minlength=batch.num_rows * dimensions).reshape(batch.num_rows, dimensions)
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(norm == 0, 1.0, norm)


def hash_embeddings(items: DataFrame, key: str, title: Column, body: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """key, vector: counts of hashed features with their signs, scaled to length 1.

    Texts are dealt out before the map, as a file's row group may hold very many of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                vectors = _hashed(part, dimensions)
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * dimensions
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))], ["key", "vector"])

    dealt = items.select(F.col(key).cast("string").alias("key"), title.alias("title"), body.alias("body"))
    dealt = dealt.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    return dealt.select("key", T.tokens(F.col("title")).alias("title"), T.tokens(F.col("body")).alias("body")).mapInArrow(run, "key string, vector array<double>")
