"""Counts over an archive: histograms, summaries, estimates, diagnostics, volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text as T


def date_of(created: str = "created_at", updated: str = "updated_at") -> Column:
    return F.coalesce(F.col(created), F.col(updated))


def histogram(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.groupBy(value.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("histogram"), "value", "n")


def corpus_histograms(conversations: DataFrame, messages: DataFrame, warnings: DataFrame) -> DataFrame:
    """histogram, value, n: messages by role, blocks by type, conversations by year, warnings by code."""
    return (
        histogram(messages, "role", F.col("role"))
        .unionByName(histogram(messages, "block", F.col("block_type")))
        .unionByName(histogram(conversations, "year", F.coalesce(F.year(date_of()).cast("string"), F.lit("undated"))))
        .unionByName(histogram(warnings, "warning", F.col("code")))
    )


def corpus_summary(conversations: DataFrame, messages: DataFrame, path: DataFrame) -> DataFrame:
    """One row: conversations, graph and path messages, alternates, first and last date."""
    talks = conversations.agg(F.count(F.lit(1)).alias("conversations"), F.min(date_of()).alias("earliest"), F.max(date_of()).alias("latest"))
    graph = messages.agg(F.count(F.lit(1)).alias("graph_messages"))
    visible = path.agg(F.count(F.lit(1)).alias("path_messages"))
    # One row each: aggregates without keys.
    return talks.join(graph).join(visible).withColumn("alternate_messages", F.greatest(F.lit(0).cast("long"), F.col("graph_messages") - F.col("path_messages")))


def created_bounds(conversations: DataFrame) -> DataFrame:
    """The archive summary's bounds, by creation only."""
    return conversations.agg(F.count(F.lit(1)).alias("conversations"), F.min("created_at").alias("earliest"), F.max("created_at").alias("latest"))


def run_estimate(representations: DataFrame) -> DataFrame:
    """One row: items, messages, characters, approximate tokens, truncated items."""
    return representations.agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("message_count").alias("messages"),
        F.sum("character_count").alias("characters"),
        F.sum("original_character_count").alias("original_characters"),
        F.count_if("truncated").alias("truncated"),
    ).withColumn("approximate_tokens", T.approximate_tokens(F.col("characters")))


def warning_diagnostics(warnings: DataFrame) -> DataFrame:
    """Per code: warnings and distinct conversations."""
    return warnings.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conversation_id").alias("conversations"))


#: Fixed values. What a warning about stated edges counts.
EDGE_COUNTS = ("nodes_with_differences", "missing_source_edges", "conflicting_source_edges", "dangling_source_edges", "duplicate_source_edges")


def diagnostics(warnings: DataFrame) -> DataFrame:
    """section, name, n: warnings by code and severity, conversations by code, unknown content types, edge totals, suppressed details.

    warnings: code, severity, conversation_id, context (JSON). One pass: each warning adds to a few counters, which are
    summed before they move; only distinct conversations need a shuffle of their own.
    """
    field = lambda name: F.get_json_object("context", f"$.{name}")
    entry = lambda section, name, n: F.struct(F.lit(section).alias("section"), name.alias("name"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))
    one, code = F.lit(1), F.col("code")
    edges = [F.when(code == "source_child_edges_disagree", entry("source_child_edge_totals", F.lit(c), F.try_to_number(field(c), F.lit("S999999999999")))) for c in EDGE_COUNTS]
    unknown = F.when(code == "unknown_content_type", entry("unknown_content_types", F.coalesce(field("content_type"), F.lit("None")), one))
    suppressed = entry("suppressed_count", F.lit("all"), F.when(code == "warnings_suppressed", F.try_to_number(field("suppressed_count"), F.lit("S999999999999"))))
    counters = F.array_compact(F.array(entry("warning_count", F.lit("all"), one), entry("warnings_by_code", code, one), entry("warnings_by_severity", F.col("severity"), one), unknown, suppressed, *edges))
    sums = warnings.select(F.explode(counters).alias("c")).groupBy("c.section", "c.name").agg(F.sum("c.n").alias("n"))
    affected = warnings.groupBy(code.alias("name")).agg(F.countDistinct("conversation_id").alias("n"))
    return sums.unionByName(affected.select(F.lit("affected_conversations_by_code").alias("section"), "name", "n"))


def date_ranges(items: DataFrame, group: str) -> DataFrame:
    """group, dates: the months that a group's dated conversations span."""
    return items.groupBy(group).agg(T.date_range(F.min(date_of()), F.max(date_of())).alias("dates"))


#: Fixed values. Block types that hold a model's reasoning.
REASONING = ("thinking_trace", "reasoning_summary")


def shown_blocks(blocks: DataFrame, system: bool = False, tools: bool = False, reasoning: bool = False) -> DataFrame:
    """The blocks that volumes print: of users and assistants, on request of others, and of reasoning. blocks: role, block_type.

    A message without any such block isn't printed.
    """
    roles = ["user", "assistant", *(["system", "developer"] if system else []), *(["tool"] if tools else [])]
    kept = blocks.where(F.col("role").isin(*roles))
    return kept if reasoning else kept.where(~F.col("block_type").isin(*REASONING))


def duplicate_ids(conversations: DataFrame) -> DataFrame:
    """The second and later conversations of an id, in archive order."""
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("source_index"))
    return conversations.where("conversation_id is not null").withColumn("occurrence", place).where("occurrence > 1").select("source_index", "conversation_id", "occurrence")


def warning_budget(warnings: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first `limit` warnings by `order`, and one row that counts the others; nothing is ranked if all fit."""
    total = warnings.count()
    if total <= limit:
        return warnings.select("code", "source_index", F.lit(None).cast("long").alias("suppressed"))
    first = warnings.orderBy(*order).limit(limit).select("code", "source_index", F.lit(None).cast("long").alias("suppressed"))
    rest = warnings.sparkSession.createDataFrame([("warnings_suppressed", None, total - limit)], "code string, source_index long, suppressed long")
    return first.unionByName(rest)


def volumes(conversations: DataFrame, messages: DataFrame, mode: str) -> DataFrame:
    """Per volume: conversations and their visible messages."""
    labelled = conversations.select("source_index", T.volume_label(date_of(), mode).alias("label"))
    counts = messages.groupBy("source_index").agg(F.count(F.lit(1)).alias("n"))
    return labelled.join(counts, "source_index", "left").groupBy("label").agg(F.count(F.lit(1)).alias("conversation_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("message_count"))
