"""Conversation representations: the role-labelled text of the visible path, bounded, with key and digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions import vocabulary as V
from threadloom.operators.order import running
from threadloom.operators.stats import date_of
from threadloom.plans.session import settled


def block_text(include_reasoning: bool = False):
    """What a block contributes; references become a note, tool results nothing."""
    kind = F.col("block_type")
    readable = kind.isin(*V.TEXT_BLOCKS, *(V.REASONING_BLOCKS if include_reasoning else ()))
    note = F.concat(F.lit("["), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" omitted]"))
    return F.when(readable, F.col("text")).when(kind.isin(*V.REFERENCE_BLOCKS), note)


def representations(conversations: DataFrame, messages: DataFrame, max_characters: int = 32_000, max_conversations: int | None = None, include_reasoning: bool = False) -> DataFrame:
    """conversations: source_index, source_path, conversation_id, title, dates. messages: the path's blocks, in order of
    path_pos and block_pos. Conversations without a visible message keep their title.
    """
    if max_conversations is not None:
        conversations = conversations.orderBy(date_of().asc_nulls_last(), "source_index").limit(max_conversations)
    blocks = messages.where(F.col("role").isin("user", "assistant")).withColumn("_t", block_text(include_reasoning)).where("_t <> ''")
    bodies = blocks.groupBy("source_index", "path_pos", "role").agg(F.array_sort(F.collect_list(F.struct("block_pos", "_t"))).alias("_b"))
    body = T.normalize_lines(F.array_join(F.transform("_b", lambda b: b["_t"]), "\n\n"))
    spoken = bodies.withColumn("_body", body).where("_body <> ''").select("source_index", "path_pos", F.concat(F.initcap("role"), F.lit(":\n"), F.col("_body")).alias("_m"))
    joined = spoken.groupBy("source_index").agg(F.array_sort(F.collect_list(F.struct("path_pos", "_m"))).alias("_ms"))
    talks = conversations.join(joined, "source_index", "left")
    title = T.normalize_lines(F.when(F.coalesce("title", F.lit("")) == "", "Untitled conversation").otherwise(F.col("title")))
    talks = talks.withColumn("title", title).withColumn("_body", F.array_join(F.transform("_ms", lambda m: m["_m"]), "\n\n"))
    whole = F.concat_ws("\n\n", F.concat(F.lit("Title:\n"), F.col("title")), F.col("_body"))
    talks = talks.withColumn("_whole", whole).withColumn("text", T.truncate_middle(F.col("_whole"), max_characters))
    return talks.select(
        T.conversation_key(F.col("source_index"), F.col("source_path"), F.col("conversation_id")).alias("conversation_key"),
        "source_index",
        "conversation_id",
        "title",
        "created_at",
        "updated_at",
        "text",
        F.coalesce(F.size("_ms"), F.lit(0)).cast("long").alias("message_count"),
        F.length("text").cast("long").alias("character_count"),
        F.length("_whole").cast("long").alias("original_character_count"),
        (F.length("_whole") > max_characters).alias("truncated"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def chronological(items: DataFrame) -> DataFrame:
    """position: the place by date, undated last, then archive order. Only slim rows are ranked, range by range."""
    slim = items.select("conversation_key", "created_at", "updated_at", "source_index")
    placed = running(slim, [date_of().asc_nulls_last(), "source_index"], settled).withColumn("position", (F.col("place") + 1).cast("int"))
    return items.join(placed.select("conversation_key", "position"), "conversation_key")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole, between = hashlib.sha256(), b""
    for batch in batches:
        for digest in batch.column(0).to_pylist():
            whole.update(between + digest.encode())
            between = b"\0"
    yield pa.RecordBatch.from_arrays([pa.array([whole.hexdigest()])], ["fingerprint"])


def source_fingerprint(items: DataFrame) -> DataFrame:
    """One digest over all text digests in chronological order: one task by definition, which streams sorted slim rows."""
    slim = chronological(items).select("position", "text_sha256").repartition(1).sortWithinPartitions("position")
    return slim.select("text_sha256").mapInArrow(_digest, "fingerprint string")
