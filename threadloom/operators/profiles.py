"""Conversation profiles by transparent rules: keywords, projects, sentences, types, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text as T
from threadloom.functions import vocabulary as V


def token_counts(items: DataFrame, key: str, terms) -> DataFrame:
    """key, token, n, first (place of the first occurrence)."""
    return items.select(key, F.posexplode(terms).alias("pos", "token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def dealt(items: DataFrame, key: str) -> DataFrame:
    """Items by key, each in one partition: counts of their terms and joins by key then need no exchange.

    A text moves once; its terms, each with the key, would be several times as large.
    """
    return items.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def keywords(items: DataFrame, key: str, terms, k: int = 12) -> DataFrame:
    """The k most frequent tokens of each item, ties by first occurrence: key, keywords."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    top = token_counts(dealt(items, key), key, terms).withColumn("rank", rank).where(F.col("rank") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "token")))
    return top.groupBy(key).agg(F.transform(ordered, lambda x: x["token"]).alias("keywords"))


def recurring_handles(items: DataFrame, batch_size: int | None, key: str = "conversation_key", text: str = "whole") -> DataFrame:
    """batch, handle, n: handles in at least 3 and at most max(3, 45%) of a batch's items; items carry position."""
    batch = F.lit(0).cast("long") if batch_size is None else F.floor((F.col("position") - 1) / batch_size)
    rows = items.select(batch.alias("batch"), key, F.array_distinct(T.handles(F.col(text))).alias("handles"))
    sizes = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("size"))
    counts = rows.select("batch", F.explode("handles").alias("handle")).groupBy("batch", "handle").agg(F.count(F.lit(1)).alias("n"))
    most = F.greatest(F.lit(3), F.floor(F.col("size") * F.lit(0.45)))
    return counts.join(sizes, "batch").where((F.col("n") >= 3) & (F.col("n") <= most)).select("batch", "handle", "n")


def profiles(items: DataFrame, batch_size: int | None = 8) -> DataFrame:
    """One profile per representation (conversation_key, title, text, position).

    Recurrence of handles is judged within batches of `batch_size` items by position; None takes the whole archive.
    """
    both = F.concat_ws(" ", "title", "text")
    rows = items.withColumn("whole", both)
    common = recurring_handles(rows, batch_size).groupBy("batch").agg(F.collect_set("handle").alias("recurring"))
    batch = F.lit(0).cast("long") if batch_size is None else F.floor((F.col("position") - 1) / batch_size)
    found = keywords(rows, "conversation_key", T.tokens(F.concat_ws(" ", "title", "title", "text")))
    rows = dealt(rows, "conversation_key").join(found, "conversation_key", "left").withColumn("batch", batch).join(common, "batch", "left")
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({"recurring": F.coalesce("recurring", empty), "keywords": F.coalesce("keywords", empty), "_handles": T.handles(F.col("whole")), "_title": T.tokens(F.col("title")), "_told": T.told(F.col("text"))})
    own = lambda h: F.contains(h, F.lit("-")) & ~F.contains(h, F.lit(".")) & (F.size(F.filter("_handles", lambda x: x == h)) >= 2)
    projects = F.slice(F.filter(F.array_distinct("_handles"), lambda h: F.array_contains("recurring", h) | own(h)), 1, 2)
    named = lambda words: F.transform(words, lambda w: T.label(F.array(w), w))
    primary = F.when(F.size("_title") > 0, F.slice("_title", 1, 3)).otherwise(F.slice("keywords", 1, 3))
    return rows.select(
        "conversation_key",
        "position",
        T.synopsis(F.col("text"), F.col("title")).alias("synopsis"),
        T.label(primary, F.lit("General conversation")).alias("primary_subject"),
        named(F.slice("keywords", 4, 5)).alias("secondary_subjects"),
        named(projects).alias("projects"),
        T.conversation_type(F.col("text")).alias("conversation_type"),
        named(F.slice("keywords", 1, 6)).alias("entities"),
        T.marked(F.col("_told"), V.GOAL_MARKERS, 3).alias("goals"),
        T.marked(F.col("_told"), V.DECISION_MARKERS).alias("decisions"),
        T.marked(F.col("_told"), V.QUESTION_MARKERS).alias("unresolved_questions"),
        named(F.slice("keywords", 9, 4)).alias("recurring_themes"),
        T.temporal_role(F.col("text")).alias("temporal_role"),
        F.lit(0.5).alias("confidence"),
    )


def labels(profile_rows: DataFrame) -> DataFrame:
    """conversation_key, label: every subject, project and theme that isn't blank."""
    every = F.concat(F.array("primary_subject"), "secondary_subjects", "projects", "recurring_themes")
    return profile_rows.select("conversation_key", "confidence", F.explode(every).alias("label")).where(F.trim("label") != "")


def refine(base: DataFrame, refined: DataFrame) -> DataFrame:
    """The base profiles, with those of `refined` in their place."""
    return base.join(refined.select("conversation_key"), "conversation_key", "left_anti").unionByName(refined)
