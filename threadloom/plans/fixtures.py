"""The archive's relations from flat tables of conversations, with branches, gaps and faults planted by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_index, conversation_id, source_path, title, dates, current_node_id."""
    rows = read(spark, sf_dir, "conversations")
    talks = rows.groupBy(F.col("conv_id").alias("source_index")).agg(F.max("turn").alias("last"), F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))["text"].alias("opening"))
    c = F.col("source_index")
    start = F.timestamp_seconds(F.lit(1746266400) + c * 25200)
    return talks.select(
        c,
        F.concat(F.lit("conv-"), F.when(c % 41 == 40, c - 1).otherwise(c).cast("string")).alias("conversation_id"),
        F.lit("conversations.json").alias("source_path"),
        F.substring("opening", 1, 40).alias("title"),
        F.when(c % 17 != 0, start).alias("created_at"),
        F.when(c % 34 != 0, start + F.expr("interval 1 day")).alias("updated_at"),
        F.when(c % 31 != 0, F.concat(F.lit("c"), c.cast("string"), F.lit("-t"), F.col("last").cast("string"))).alias("current_node_id"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_index, node_id, parent_node_id, role, text, block_type, declared.

    Planted: roots without a message, alternates, nodes below a missing parent, cycles off the path, and declared
    children that miss, repeat or invent edges.
    """
    rows = read(spark, sf_dir, "conversations")
    c, t = F.col("conv_id"), F.col("turn")
    name = lambda turn: F.concat(F.lit("c"), c.cast("string"), F.lit("-t"), turn.cast("string"))
    own = lambda suffix: F.concat(F.lit("c"), c.cast("string"), F.lit(suffix))
    none = F.lit(None).cast("string")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    rows = rows.withColumn("last", last)
    next_turn = F.when((t < F.col("last")) & ((c + t) % 7 != 0), F.array(name(t + 1)))
    declared = F.concat(
        F.coalesce(next_turn, F.array().cast("array<string>")),
        F.when((c + t) % 11 == 0, F.array(own("-ghost"))).otherwise(F.array().cast("array<string>")),
        F.when(((c + t) % 13 == 0) & (t < F.col("last")), F.array(name(t + 1), name(t + 1))).otherwise(F.array().cast("array<string>")),
    )
    parent = F.when(t == 0, own("-root")).otherwise(name(t - 1))
    kind = F.when((F.col("role") == "assistant") & ((c + t) % 5 == 0), "code").when((c + t) % 37 == 0, "image_reference").otherwise("markdown")
    said = rows.select(c.alias("source_index"), name(t).alias("node_id"), parent.alias("parent_node_id"), "role", "text", kind.alias("block_type"), F.when(t % 3 != 2, declared).alias("declared"))
    alternate = rows.where((t > 0) & ((c + t) % 19 == 0)).select(c.alias("source_index"), F.concat(name(t), F.lit("-alt")).alias("node_id"), parent.alias("parent_node_id"), "role", F.concat(F.lit("Alternate: "), F.col("text")).alias("text"), F.lit("markdown").alias("block_type"), F.lit(None).cast("array<string>").alias("declared"))
    each = rows.where(t == 0)

    def plant(where, node, above) -> DataFrame:
        return each.where(where).select(c.alias("source_index"), node.alias("node_id"), above.alias("parent_node_id"), none.alias("role"), none.alias("text"), none.alias("block_type"), F.lit(None).cast("array<string>").alias("declared"))

    roots = plant(F.lit(True), own("-root"), none)
    lost = plant(c % 23 == 0, own("-lost"), own("-missing"))
    ring = plant(c % 29 == 0, own("-x"), own("-y")).unionByName(plant(c % 29 == 0, own("-y"), own("-x")))
    return said.unionByName(alternate).unionByName(roots).unionByName(lost).unionByName(ring)


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_index, conversation_id, code: what the planted faults call forth."""
    from threadloom.operators import stats, tree
    from threadloom.plans.session import settled

    # Every code reads the graph: it is made once.
    talks, graph = settled(conversations(spark, sf_dir)), settled(nodes(spark, sf_dir))
    codes = tree.dangling_parents(graph).select("source_index", F.lit("dangling_parent").alias("code"))
    codes = codes.unionByName(tree.edge_disagreement(graph).select("source_index", F.lit("source_child_edges_disagree").alias("code")))
    codes = codes.unionByName(tree.orphans(graph, talks).select("source_index", F.lit("orphan_component").alias("code")))
    codes = codes.unionByName(talks.where("current_node_id is null").select("source_index", F.lit("missing_current_node").alias("code")))
    codes = codes.unionByName(stats.duplicate_ids(talks).select("source_index", F.lit("duplicate_conversation_id").alias("code")))
    return codes.join(talks.select("source_index", "conversation_id"), "source_index")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as representations, with sentences appended by rule so that every marker occurs."""
    rows = read(spark, sf_dir, "documents")
    d = F.col("doc_id")
    tail = (
        F.when(d % 5 == 0, F.lit(" We decided to keep the plan of alpha-beta-tool. It remains to check alpha-beta-tool and report_final.csv."))
        .when(d % 5 == 1, F.concat(F.lit(" Work resumed after the hiatus! The goal is to build project-"), (d % 20).cast("string"), F.lit(".md and tool-kit.")))
        .when(d % 5 == 2, F.lit(" The build failed with a traceback. We will adopt a python notebook instead of midi music."))
        .otherwise(F.lit(""))
    )
    text = F.concat(F.col("text"), tail)
    start = F.timestamp_seconds(F.lit(1746266400) + (d * 7919 % 500) * 86400)
    return rows.select(
        T.conversation_key(d, F.lit("documents"), F.concat(F.lit("doc-"), d.cast("string"))).alias("conversation_key"),
        d.alias("source_index"),
        F.regexp_replace(F.substring("text", 1, 30), r"\s+", " ").alias("title"),
        text.alias("text"),
        F.when(d % 17 != 0, start).alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        (d + 1).alias("position"),
        F.col("lang"),
        F.col("source"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, vector, category (from the table's label)."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(F.format_string("v%06d", "vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vector"), F.format_string("category-%04d", F.col("label") + 1).alias("category"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dated members of projects: project, key, at, kind, value."""
    rows = read(spark, sf_dir, "events")
    return rows.select(F.concat(F.lit("project-"), F.col("user_id").cast("string")).alias("project"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"), F.col("value"))
