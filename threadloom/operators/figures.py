"""Data behind figures: monthly dynamics, co-occurrence, lanes, open work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.order import running
from threadloom.plans.session import settled


def period_pivot(rows: DataFrame, period, value: str, most: int = 8) -> DataFrame:
    """period by value, dense: a count for every period and each of the `most` most frequent values."""
    top = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(most)
    kept = rows.select(period.alias("period"), value)
    grid = kept.select("period").distinct().join(F.broadcast(top.agg(F.collect_list(value).alias("vs"))))  # one row of at most `most` values
    grid = grid.select("period", F.explode("vs").alias(value))
    counts = kept.groupBy("period", value).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["period", value], "left").select("period", F.col(value).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))


def cooccurrence(members: DataFrame, item: str, value: str) -> DataFrame:
    """left, right, n: items that hold both values, the diagonal included; each item counts once."""
    sets = members.groupBy(item).agg(F.sort_array(F.collect_set(value)).alias("vs"))
    return sets.select(F.explode("vs").alias("left"), "vs").select("left", F.explode("vs").alias("right")).groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))


def lane_edges(edges: DataFrame, first_project: DataFrame) -> DataFrame:
    """Edges whose ends share their first project. first_project: key, project."""
    a = first_project.select(F.col("key").alias("source_key"), "project")
    b = first_project.select(F.col("key").alias("target_key"), F.col("project").alias("_p"))
    return edges.join(a, "source_key").join(b, "target_key").where("project = _p").select("project", "source_key", "target_key", "similarity")


def marker_size(messages, evidence):
    return F.greatest(F.lit(8), F.least(F.lit(22), F.lit(7) + messages + evidence))


def aliases(names: DataFrame, name: str) -> DataFrame:
    """name, alias: Project A, B, ... by name; after Z the numbers go on."""
    placed = running(names.select(name).distinct(), [name], settled)
    place = F.col("place") + 1
    letter = F.when(place <= 26, F.char(64 + place)).otherwise(place.cast("string"))
    return placed.select(name, F.concat(F.lit("Project "), letter).alias("alias"))


def open_work(timelines: DataFrame, questions: str = "unresolved") -> DataFrame:
    """project, ordinal, question."""
    return timelines.select("project", F.posexplode(questions).alias("ordinal", "question"))
