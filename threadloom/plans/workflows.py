"""Whole runs: ingest an export, compile volumes, build the semantic atlas, write the book, verify."""

from __future__ import annotations

import os
import shutil
import tempfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import schema as S
from threadloom.functions import text as T
from threadloom.operators import book, longitudinal, represent, safety, simgraph, stats, taxonomy
from threadloom.operators import profiles as P
from threadloom.operators.order import running
from threadloom.plans import providers
from threadloom.plans.session import settled
from threadloom.sources import archive_json, manifests, normalize, render, zip_export


@dataclass(frozen=True)
class AtlasOptions:
    """Defaults of a run."""

    include_reasoning: bool = False
    max_conversations: int | None = None
    max_characters: int = 32_000
    max_neighbors: int = 10
    min_similarity: float = 0.32
    resolution: float = 1.0
    max_leaf_categories: int = 64
    refined_per_category: int = 3
    max_refined: int = 0
    review_threshold: float = 0.65
    cache_folder: str | None = None


@dataclass(frozen=True)
class VolumeOptions:
    mode: str = "yearly"
    include_system: bool = False
    include_tools: bool = False
    include_reasoning: bool = False
    max_conversations: int | None = None
    redactions: tuple[tuple[str, str], ...] = field(default=())


def ingest(spark: SparkSession, path: str, limits: S.Limits = S.Limits(), strict: bool = False, hash_members: bool = False, hash_archive: bool = True) -> dict:
    """conversation, node, message, block, warning and the manifest of an export; unsafe archives are not opened."""
    found = zip_export.manifest(spark, path, limits, hash_members, hash_archive)
    if found["warnings"]:
        raise S.UnsafeArchive(sorted({w["code"] for w in found["warnings"]}))
    chosen, notes = zip_export.select_payload(found["files"])
    frames = normalize.normalize(zip_export.payloads(spark, path, chosen, limits), limits, strict)
    if notes:
        rows = [(n["severity"], n["code"], n["source_path"], None, None, "/", None) for n in notes]
        if strict:
            raise S.StrictModeViolation("strict mode allows no warnings")
        frames["warning"] = frames["warning"].unionByName(spark.createDataFrame(rows, S.WARNING))
    return frames | {"manifest": found}


def path_blocks(frames: dict) -> DataFrame:
    return frames["block"].where("is_on_current_path").withColumnRenamed("type", "block_type")


def safe_frames(frames: dict) -> tuple[dict, DataFrame]:
    """The archive without conversations that aren't to be published; everything later is derived from it."""
    said = frames["block"].where("is_on_current_path and text <> ''").groupBy("source_index").agg(F.array_sort(F.collect_list(F.struct("path_pos", "block_pos", "text"))).alias("bs"))
    talks = frames["conversation"].join(said, "source_index", "left")
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.array_join(F.transform("bs", lambda b: b["text"]), "\n"))
    decisions = settled(safety.classify(talks.select("source_index", text.alias("safety_text"))))
    kept = {k: safety.included(frames[k], decisions) for k in ("conversation", "node", "message", "block")}
    # Positions, and with them keys, are those of the archive that is handed on: ranks over slim rows.
    moved = running(kept["conversation"].select("source_index"), ["source_index"], settled).select("source_index", F.col("place").cast("long").alias("_new"))
    shifted = {k: v.join(moved, "source_index").drop("source_index").withColumnRenamed("_new", "source_index") for k, v in kept.items()}
    return frames | shifted, decisions


def analysis(frames: dict) -> dict:
    """Counts of the archive: histograms and totals."""
    messages = frames["message"]
    counts = frames["block"].withColumnRenamed("type", "block_type")
    parts = stats.histogram(messages, "role", F.col("role")).unionByName(stats.histogram(counts, "block", F.col("block_type")))
    parts = parts.unionByName(stats.histogram(frames["conversation"], "year", F.coalesce(F.year(stats.date_of()).cast("string"), F.lit("undated")))).unionByName(stats.histogram(frames["warning"], "warning", F.col("code")))
    out: dict = {}
    for r in parts.orderBy("histogram", "value").collect():
        out.setdefault(r["histogram"], {})[r["value"]] = r["n"]
    total = stats.corpus_summary(frames["conversation"], messages, messages.where("is_on_current_path")).first()
    return out | {k: str(v) if k in ("earliest", "latest") and v is not None else v for k, v in total.asDict().items()}


def compile_volumes(frames: dict, folder: str | Path, options: VolumeOptions = VolumeOptions()) -> list[dict]:
    """analysis.json, one HTML file per volume, index.html and manifest.json. Conversations stream, one at a time."""
    out = Path(folder)
    rules = render.compile_rules(options.redactions)
    archive_json.write_json(out / "analysis.json", analysis(frames))
    talks = frames["conversation"].withColumn("label", T.volume_label(stats.date_of(), options.mode)).withColumn("_at", stats.date_of())
    if options.max_conversations is not None:
        talks = talks.orderBy(F.col("_at").asc_nulls_last(), "source_path", F.coalesce("conversation_id", F.lit(""))).limit(options.max_conversations)
    shown = stats.shown_blocks(path_blocks(frames), options.include_system, options.include_tools, options.include_reasoning)
    messages = shown.groupBy("source_index", "path_pos", "role").agg(F.array_sort(F.collect_list(F.struct("block_pos", F.col("block_type").alias("type"), "text", "reference", "language"))).alias("blocks"))
    whole = messages.groupBy("source_index").agg(F.array_sort(F.collect_list(F.struct("path_pos", "role", "blocks"))).alias("messages"))
    rows = talks.join(whole, "source_index", "left").select("label", "title", F.date_format("_at", "yyyy-MM-dd").alias("day"), "_at", "source_path", F.coalesce("conversation_id", F.lit("")).alias("cid"), "messages")
    rows = settled(rows.repartitionByRange("label", "_at", "source_path", "cid").sortWithinPartitions("label", F.col("_at").asc_nulls_last(), "source_path", "cid"))
    volumes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("conversation_count"), F.coalesce(F.sum(F.size("messages")), F.lit(0)).alias("message_count")).orderBy("label").collect()
    written = []
    for v in volumes:
        label = v["label"]

        def body(label=label):
            yield f"<h1>{label}</h1>\n"
            for r in rows.where(F.col("label") == label).orderBy(F.col("_at").asc_nulls_last(), "source_path", "cid").toLocalIterator():
                yield render.conversation({"title": r["title"], "day": r["day"], "messages": [m.asDict(recursive=True) for m in r["messages"] or ()]}, rules)

        file = f"volume-{label}.html"
        archive_json.atomic_write(out / file, render.page(label, body()))
        written.append({"label": label, "file": file, "conversation_count": v["conversation_count"], "message_count": v["message_count"], "size_bytes": (out / file).stat().st_size, "sha256": zip_export.file_sha256(str(out / file))})
    archive_json.atomic_write(out / "index.html", render.index(written))
    archive_json.write_json(out / "manifest.json", {"volumes": written, "mode": options.mode})
    return written


def atlas(frames: dict, embeddings: providers.EmbeddingProvider, analyses: providers.AnalysisProvider, options: AtlasOptions = AtlasOptions()) -> dict[str, DataFrame]:
    """All relations of the semantic atlas by name."""
    items = settled(represent.chronological(represent.representations(frames["conversation"], path_blocks(frames), options.max_characters, options.max_conversations, options.include_reasoning)))
    if items.isEmpty():
        raise ValueError("an empty archive has no atlas")
    vectors = providers.cached_embeddings(items, embeddings, options.cache_folder)
    made = providers.cached_profiles(items, analyses, f"{options.cache_folder}-profiles" if options.cache_folder else None)
    edges = settled(simgraph.similarity_graph(vectors, options.min_similarity, options.max_neighbors))
    keys = vectors.select("key")
    found = settled(simgraph.communities(keys, edges, options.resolution))
    membership = settled(simgraph.consolidate(vectors, found, options.max_leaf_categories))
    slim = membership.select("key", "category")
    dates = items.select(F.col("conversation_key").alias("key"), stats.date_of().alias("at"))
    if options.max_refined:
        central = taxonomy.representatives(slim, edges)
        members = slim.join(central.select("category", "key", F.col("rank").alias("central")), ["category", "key"], "left").join(dates, "key", "left")
        chosen = longitudinal.refinement(members, options.refined_per_category, options.max_refined)
        again = items.join(chosen.select(F.col("key").alias("conversation_key")), "conversation_key", "left_semi")
        better = analyses.refined if isinstance(analyses, providers.Routed) else analyses
        made = settled(P.refine(made, providers.cached_profiles(again, better, f"{options.cache_folder}-refined" if options.cache_folder else None)))
    drafts = settled(taxonomy.drafts(slim, P.labels(made), edges, dates))
    naming = settled(analyses.interpret(drafts))
    providers.covered(drafts, "category", naming, "category")
    confidence = made.select(F.col("conversation_key").alias("key"), F.col("confidence").alias("analysis"))
    assigned = settled(taxonomy.assignments(slim, edges, confidence, naming))
    seconds = settled(taxonomy.secondary(slim, edges))
    projects = longitudinal.project_members(made).select("project", F.col("conversation_key").alias("key"), "synopsis", "unresolved_questions").join(dates, "key")
    return {
        "representation": items,
        "embedding": vectors,
        "profile": made,
        "edge": simgraph.shared_signals(edges, P.labels(made)),
        "membership": membership,
        "draft": drafts,
        "category": naming.join(taxonomy.related(drafts).groupBy("category").agg(F.sort_array(F.collect_list("other")).alias("related")), "category", "left"),
        "domain": taxonomy.parents(slim, naming),
        "assignment": assigned.join(seconds.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]).alias("secondary")), "key", "left"),
        "category_profile": longitudinal.category_profiles(slim, made),
        "timeline": longitudinal.timelines(projects.select("project", "key", "at")),
        "synthesis": longitudinal.synthesis(made, projects.select("project", "key", "at"), items.select(F.col("conversation_key").alias("key"), "title")),
        "review": taxonomy.review_queue(confidence, edges, assigned, seconds, membership, options.review_threshold),
        "graph_summary": taxonomy.graph_summary(keys, edges, slim),
    }


def catalog(relations: dict[str, DataFrame]) -> DataFrame:
    """representation, profile and assignment in one row per conversation; a missing partner is an error."""
    items = relations["representation"].drop("text", "position")
    rows = items.join(relations["profile"].drop("position", "confidence"), "conversation_key").join(relations["assignment"].withColumnRenamed("key", "conversation_key"), "conversation_key")
    if rows.count() != items.count():
        raise ValueError("the catalog lacks a profile or an assignment")
    return rows


def export_atlas(relations: dict[str, DataFrame], folder: str | Path) -> None:
    """Parquet (zstd) for what grows with the archive; JSON, Markdown and HTML for what the categories bound."""
    out = Path(folder)
    write = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet((out / name).as_posix())
    write(catalog(relations), "catalog.parquet")
    write(relations["embedding"], "embeddings.parquet")
    write(relations["edge"], "graph.parquet")
    write(relations["review"], "review.parquet")
    plain = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731  bounded by the leaf categories
    domains, categories, timelines = plain(relations["domain"].orderBy("name")), plain(relations["category"].orderBy("category")), plain(relations["timeline"].orderBy("project"))
    archive_json.write_json(out / "taxonomy.json", {"domains": domains, "categories": categories})
    archive_json.write_json(out / "profiles.json", plain(relations["category_profile"].orderBy("category")))
    archive_json.write_json(out / "timelines.json", timelines)
    archive_json.write_json(out / "review_counts.json", plain(taxonomy.review_counts(relations["review"]).orderBy("kind", "value")))
    sections: dict[str, list[str]] = {}
    for r in relations["synthesis"].orderBy("section", "rank").collect():
        sections.setdefault(r["section"], []).append(r["value"])
    archive_json.atomic_write(out / "synthesis.md", render.synthesis_markdown(list(sections.items())))
    archive_json.atomic_write(out / "atlas.html", render.atlas(domains, categories, timelines))


def write_book(relations: dict[str, DataFrame], folder: str | Path, per_category: int = 12, overall: int = 240) -> None:
    """book.html: the taxonomy in preorder with featured conversations under a fair overall budget."""
    leaves = relations["category"].select("category", "name", "parent_name")
    domains = relations["domain"]
    tree = domains.select(F.col("parent_id").alias("category"), F.lit(None).cast("string").alias("parent"), "name").unionByName(domains.select("parent_id", F.explode("children").alias("category")).join(leaves, "category").select("category", F.col("parent_id").alias("parent"), "name"))
    placed = relations["membership"].select("key", "category")
    titles = relations["representation"].select(F.col("conversation_key").alias("key"), "title", stats.date_of().alias("at"))
    order = relations["draft"].select("category", F.posexplode("representatives").alias("rep", "key"))
    members = placed.join(relations["assignment"].select("key", "confidence"), "key").join(titles, "key").join(order, ["category", "key"], "left")
    chosen = longitudinal.round_robin(book.featured(members, per_category), "category", "rank", overall)
    related = book.symmetric_relations(relations["edge"].select("source_key", "target_key", "similarity"), relations["edge"].select(F.col("source_key").alias("key"), F.col("target_key").alias("other"), "similarity").limit(0)).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]).alias("related"))
    rows = chosen.join(titles.select("key", "title"), "key").join(relations["profile"].select(F.col("conversation_key").alias("key"), "synopsis"), "key").join(related, "key", "left").orderBy("category", "rank").collect()
    entries: dict[str, list[dict]] = {}
    for r in rows:
        entries.setdefault(r["category"], []).append({"key": r["key"], "title": r["title"], "synopsis": r["synopsis"], "related": r["related"] or []})
    counts = {r["category"]: r["n"] for r in book.subtree_counts(tree, placed).collect()}
    shown = [r.asDict() | {"n": counts.get(r["category"], 0)} for r in book.preorder(tree).join(tree.select("category", "name"), "category").orderBy(F.col("path").asc_nulls_last()).select("category", "depth", "name").collect()]
    timelines = [r.asDict(recursive=True) for r in relations["timeline"].orderBy("project").limit(24).collect()]
    archive_json.atomic_write(Path(folder) / "book.html", render.book(shown, entries, timelines, []))


def run(spark: SparkSession, export: str, folder: str | Path, atlas_options: AtlasOptions = AtlasOptions(), volume_options: VolumeOptions = VolumeOptions(), publish_safe: bool = False, limits: S.Limits = S.Limits()) -> dict:
    """Everything into an empty folder, then a manifest with a digest of each artifact."""
    out = Path(folder)
    if out.exists() and any(out.iterdir()):
        raise ValueError("the folder is not empty")
    out.mkdir(parents=True, exist_ok=True)
    frames = ingest(spark, export, limits)
    decisions = None
    if publish_safe:
        frames, decisions = safe_frames(frames)
    archive_json.write_archive(frames, frames["manifest"], out / "archive.json")
    compile_volumes(frames, out / "volumes", volume_options)
    relations = atlas(frames, providers.LocalEmbeddings(), providers.LocalAnalyses(), atlas_options)
    export_atlas(relations, out / "atlas")
    write_book(relations, out / "atlas")
    listed = [r.asDict() for r in manifests.artifacts(spark, out).orderBy("path").collect()]
    counts = safety.counts(decisions).first().asDict() if decisions is not None else None
    summary = {"artifacts": listed, "provenance": manifests.provenance(spark), "safety": counts}
    archive_json.write_json(out / "workflow.json", summary)
    return summary


def verify(spark: SparkSession, folder: str | Path) -> list[tuple[str, str]]:
    """What differs from the folder's manifest."""
    import json

    out = Path(folder)
    listed = json.loads((out / "workflow.json").read_text())["artifacts"]
    bad = manifests.verify(spark, out, listed).where("path <> 'workflow.json'")
    return sorted((r["path"], r["problem"]) for r in bad.collect())


def bundle(folder: str | Path, target: str | Path) -> None:
    """A ZIP of a finished run, published only when whole."""
    handle, name = tempfile.mkstemp(dir=Path(target).resolve().parent, suffix=".zip")
    os.close(handle)
    manifests.bundle(folder, name)
    shutil.move(name, target)
