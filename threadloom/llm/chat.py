"""Chat formatting: cumulative snapshots collapse into the longest conversation that extends them, which is rendered.

A log that stores a conversation after each turn holds every prefix of it. Each conversation gets a rolling hash over
its turns; one whose last hash is among the proper prefixes of another is dropped by an anti-join, and of equal
conversations the smallest conv_id stays. The hashes of a very common first turn are pre-aggregated before they move.

Defined results. Turns are ordered by turn, role, text, nulls first; wholly repeated rows count once. A null role is
"unknown", a null text empty. Turns without a conv_id form one conversation with a null id. An empty table gives an
empty result. A turn's text can't forge a marker: "<|" in it becomes "<\\|".
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix_hashes(turns: list[tuple[str, str]]) -> list[bytes]:
    """The hash of the first one, two, ... of the (role, text) turns; 128 bits."""
    rolling, out = hashlib.blake2b(digest_size=16), []
    for role, text in turns:
        for part in (role, text):
            data = part.encode("utf-8", "surrogatepass")
            rolling.update(len(data).to_bytes(8, "little") + data)
        out.append(rolling.copy().digest())
    return out


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|im_start|>{role}\n{text.replace('<|', chr(60) + chr(92) + '|')}<|im_end|>\n" for role, text in turns)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        talks = [[(t["role"], t["text"]) for t in turns] for turns in batch.column(1).to_pylist()]
        hashes = [prefix_hashes(t) for t in talks]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(t) for t in talks], pa.int64()),
                pa.array(hashes, pa.list_(pa.binary())),
                pa.array([render(t) for t in talks], pa.string()),
            ],
            ["conv_id", "n_turns", "hashes", "rendered"],
        )


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies (equal conversations, itself included), rendered."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns")).mapInArrow(_run, "conv_id long, n_turns long, hashes array<binary>, rendered string")
    prefixes = talks.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("_prefix")).distinct()
    first = F.min(F.struct("conv_id", "n_turns", "rendered")).alias("one")
    distinct = talks.groupBy(F.element_at("hashes", -1).alias("_whole")).agg(first, F.count(F.lit(1)).alias("n_copies"))
    kept = distinct.join(prefixes, F.col("_whole") == F.col("_prefix"), "left_anti")
    return kept.select("one.conv_id", "one.n_turns", "n_copies", "one.rendered")


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (
  SELECT conv_id, turn, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    string_agg('<|im_start|>' || role || chr(10) || replace(text, '<|', '<' || chr(92) || '|') || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS rendered
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
whole AS (SELECT rendered, min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_copies FROM p WHERE k = n_turns GROUP BY rendered)
SELECT conv_id, n_turns, n_copies, rendered FROM whole
WHERE rendered NOT IN (SELECT rendered FROM p WHERE k < n_turns)
"""
