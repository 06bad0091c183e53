"""What a dashboard shows: one JSON document of conversations, edges, timelines, synthesis and figures; corrections."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import figures, longitudinal, simgraph, stats
from threadloom.sources import archive_json


def preflight_summary(files: DataFrame) -> DataFrame:
    """One row: members, whether any is named like a conversation payload, and the codes found. files: zip_export.findings()."""
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    codes = F.array_sort(F.array_distinct(F.flatten(F.collect_set("codes"))))
    return files.agg(F.count(F.lit(1)).alias("member_count"), F.coalesce(F.bool_or(F.startswith(base, F.lit("conversations"))), F.lit(False)).alias("has_conversations"), codes.alias("codes"))


def preflight(files: DataFrame) -> dict:
    return preflight_summary(files).first().asDict()


def figure_data(relations: dict[str, DataFrame], anonymous: bool = False) -> dict[str, DataFrame]:
    """Relations behind the figures: lanes, monthly dynamics, co-occurrence, open work, marker sizes."""
    made, items = relations["profile"], relations["representation"]
    dated = items.select("conversation_key", stats.date_of().alias("at"), "message_count")
    members = longitudinal.project_members(made).select(F.col("conversation_key").alias("key"), "project", "project_pos", "unresolved_questions")
    if anonymous:
        names = figures.aliases(members, "project")
        members = members.join(names, "project").drop("project").withColumnRenamed("alias", "project")
    themes = made.select("conversation_key", F.explode("recurring_themes").alias("theme")).join(dated.where("at is not null"), "conversation_key")
    evidence = simgraph.degrees(relations["edge"]).select(F.col("node").alias("conversation_key"), "degree")
    sizes = dated.join(evidence, "conversation_key", "left").select("conversation_key", figures.marker_size(F.col("message_count"), F.coalesce("degree", F.lit(0))).alias("size"))
    first = members.where("project_pos = 0").select("key", "project")
    questions = members.groupBy("project").agg(F.array_distinct(F.flatten(F.collect_list("unresolved_questions"))).alias("unresolved"))
    return {
        "lanes": figures.lane_edges(relations["edge"], first),
        "dynamics": figures.period_pivot(themes, F.date_format("at", "yyyy-MM"), "theme"),
        "matrix": figures.cooccurrence(members, "key", "project"),
        "open_work": figures.open_work(questions),
        "sizes": sizes,
    }


def evidence(relations: dict[str, DataFrame], leaf: int = 12, domain: int = 6, projects: int = 24) -> dict[str, DataFrame]:
    """The bounded part of the atlas that a remote model is shown: profiles per category and per large project."""
    dates = relations["representation"].select(F.col("conversation_key").alias("key"), stats.date_of().alias("at"))
    made = relations["profile"].withColumnRenamed("conversation_key", "key").join(dates, "key")
    placed = made.join(relations["membership"].select("key", "category"), "key")
    parent = relations["domain"].select("parent_id", F.explode("children").alias("category"))
    members = longitudinal.project_members(made)
    return {
        "categories": longitudinal.stratified(placed, "category", leaf),
        "domains": longitudinal.stratified(placed.join(parent, "category"), "parent_id", domain),
        "projects": longitudinal.project_evidence(members, projects),
    }


def write(relations: dict[str, DataFrame], path: str | Path) -> None:
    """The dossier of an atlas whose size its options bound; rows stream to the file one by one."""
    placed = relations["membership"].select(F.col("key").alias("conversation_key"), "category")
    evidence_count = simgraph.degrees(relations["edge"]).select(F.col("node").alias("conversation_key"), F.col("degree").alias("evidence_count"))
    talks = relations["representation"].select("conversation_key", "title", stats.date_of().cast("string").alias("at"), "message_count").join(relations["profile"].drop("position"), "conversation_key").join(placed, "conversation_key").join(evidence_count, "conversation_key", "left")
    parts = {"conversations": talks.orderBy("conversation_key"), "edges": relations["edge"].orderBy("source_key", "target_key"), "timelines": relations["timeline"].orderBy("project"), "synthesis": relations["synthesis"].orderBy("section", "rank"), "categories": relations["category"].orderBy("category")}

    def text():
        for i, (name, df) in enumerate(parts.items()):
            yield ("," if i else "{") + f'\n "{name}": ['
            for j, row in enumerate(df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()):
                yield ("," if j else "") + "\n  " + row["j"]
            yield "]"
        yield "\n}\n"

    archive_json.atomic_write(path, text())


def read(spark, path: str) -> dict:
    return json.loads(Path(path).read_text())


def correction(target: str, kind: str, before, after) -> dict:
    return {"correction_id": uuid.uuid4().hex, "target": target, "kind": kind, "before": before, "after": after, "created_at": datetime.now(UTC).isoformat()}


def append_correction(path: str | Path, entry: dict) -> list[dict]:
    """The log with one more entry, written whole."""
    log = json.loads(Path(path).read_text()) if Path(path).exists() else []
    log.append(entry)
    archive_json.write_json(path, log)
    return log
