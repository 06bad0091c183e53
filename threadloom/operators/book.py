"""The book's relations: alias resolution, placements, category trees, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNCLASSIFIED = "__unclassified__"


def first_of(variant: str, *names: str, kind: str = "string") -> Column:
    """The first non-null value among alias keys of a VARIANT column."""
    return F.coalesce(*(F.try_variant_get(F.col(variant), f"$.{n}", kind) for n in names))


def placements(talks: DataFrame, catalog: DataFrame, membership: DataFrame, categories: DataFrame) -> DataFrame:
    """key, category, entry: each conversation's place.

    talks: key, conversation_id. catalog: entry (a key or an id), primary, others (array). membership: key, category.
    An entry under the key goes before one under the id. The first known category counts: primary, the entry's others,
    then the category whose list holds the key; else unclassified.
    """
    by_key = talks.join(catalog.select(F.col("entry").alias("key"), F.col("primary").alias("p1"), F.col("others").alias("o1"), F.lit(True).alias("e1")), "key", "left")
    by_id = by_key.join(catalog.select(F.col("entry").alias("conversation_id"), F.col("primary").alias("p2"), F.col("others").alias("o2"), F.lit(True).alias("e2")), "conversation_id", "left")
    listed = membership.groupBy("key").agg(F.min("category").alias("listed"))
    rows = by_id.join(listed, "key", "left")
    none = F.array().cast("array<string>")
    primary, others = F.when(F.col("e1"), F.col("p1")).otherwise(F.col("p2")), F.when(F.col("e1"), F.col("o1")).otherwise(F.col("o2"))
    wanted = F.array_compact(F.concat(F.array(primary), F.coalesce(others, none), F.array("listed")))
    asked = rows.select("key", F.coalesce("e1", "e2", F.lit(False)).alias("entry"), F.posexplode_outer(wanted).alias("pos", "category"))
    known = asked.join(categories.select("category", F.lit(True).alias("known")), "category", "left")
    return known.groupBy("key", "entry").agg(F.coalesce(F.min(F.when(F.col("known"), F.struct("pos", "category")))["category"], F.lit(UNCLASSIFIED)).alias("category"))


def preorder(categories: DataFrame, most_depth: int = 100) -> DataFrame:
    """category, depth, path: the tree in preorder by name and id; members of cycles are left for the end with null depth.

    categories: category, parent (null or unknown: a root), name.
    """
    known = categories.select(F.col("category").alias("parent"), F.lit(1).alias("_k"))
    rows = categories.join(known, "parent", "left").withColumn("parent", F.when(F.col("_k") == 1, F.col("parent"))).drop("_k")
    label = F.struct(F.lower("name").alias("n"), F.col("category").alias("c"))
    level = rows.where("parent is null").select("category", F.lit(0).alias("depth"), F.array(label).alias("path"))
    done = level
    for depth in range(1, most_depth):
        up = level.select(F.col("category").alias("parent"), F.col("path").alias("_p"))
        level = rows.join(up, "parent").select("category", F.lit(depth).alias("depth"), F.concat("_p", F.array(label)).alias("path"))
        if level.isEmpty():
            break
        done = done.unionByName(level)
    lost = rows.select("category").join(done.select("category"), "category", "left_anti")
    return done.unionByName(lost.withColumn("depth", F.lit(None).cast("int")).withColumn("path", F.lit(None).cast(done.schema["path"].dataType)))


def subtree_counts(categories: DataFrame, placed: DataFrame) -> DataFrame:
    """category, n: distinct conversations at or below a category."""
    tree = preorder(categories).where("path is not null").select("category", F.transform("path", lambda p: p["c"]).alias("above"))
    return placed.join(tree, "category").select("key", F.explode("above").alias("category")).distinct().groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def featured(members: DataFrame, most: int = 12) -> DataFrame:
    """category, rank, key: declared representatives in their order, then by confidence (none: last), date, key.

    members: category, key, rep (place among the representatives or null), confidence, at.
    """
    order = [F.col("rep").asc_nulls_last(), F.coalesce("confidence", F.lit(-1.0)).desc(), F.col("at").asc_nulls_last(), F.col("key").asc()]
    rank = F.row_number().over(Window.partitionBy("category").orderBy(*order))
    return members.withColumn("rank", rank).where(F.col("rank") <= most).select("category", "rank", "key")


def symmetric_relations(edges: DataFrame, declared: DataFrame, most: int = 8) -> DataFrame:
    """key, rank, other, similarity: edges in both directions and declared relations, each pair once, the strongest first."""
    both = edges.select(F.col("source_key").alias("key"), F.col("target_key").alias("other"), "similarity").unionByName(edges.select(F.col("target_key").alias("key"), F.col("source_key").alias("other"), "similarity")).unionByName(declared.select("key", "other", F.col("similarity").cast("double").alias("similarity")))
    once = both.where("key <> other").groupBy("key", "other").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "other"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select("key", "rank", "other", "similarity")


def merged_profiles(categories: DataFrame, profiles: DataFrame, fields: list[str]) -> DataFrame:
    """Categories with their profile's fields where they have none themselves (null, blank or empty)."""
    other = profiles.select("category", *(F.col(f).alias(f"_{f}") for f in fields))

    def pick(f: str) -> Column:
        blank = F.size(f) <= 0 if categories.schema[f].dataType.typeName() == "array" else F.coalesce(F.trim(f), F.lit("")) == ""
        return F.when(F.col(f).isNull() | blank, F.coalesce(F.col(f"_{f}"), F.col(f))).otherwise(F.col(f)).alias(f)

    return categories.join(other, "category", "left").select(*(pick(c) if c in fields else F.col(c) for c in categories.columns))


def reconcile(known: DataFrame, received: DataFrame, default: str) -> DataFrame:
    """category, overview: the first profile received for each known category, others dropped, missing ones by default.

    received: category, seq, overview.
    """
    first = received.groupBy("category").agg(F.min_by("overview", "seq").alias("overview"))
    return known.select("category").join(first, "category", "left").select("category", F.coalesce("overview", F.lit(default)).alias("overview"))
