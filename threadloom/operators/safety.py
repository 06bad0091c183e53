"""Local publication decisions by explainable rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions import vocabulary as V

# Fixed values. What must not be in a release: names (* stands for any characters), folders, credentials; which files are
# read as text, up to which size; folders of tools, which aren't part of it.
RELEASE_NAMES = (
    "conversations.json", "conversations-*.json", "*.ir.json", "api_budget_ledger.json", "run_identity.json", "semantic_manifest.json", "semantic_book_manifest.json",
    "run_manifest.json", "taxonomy.json", "category_profiles.json", "project_timelines.json", "review_queue.json", "semantic_atlas.html", "semantic-atlas.html",
)
RELEASE_FOLDERS = (".semantic_cache", "outputs", "private_data", "source_exports")
CREDENTIALS = ("sk-[A-Za-z0-9_-]{20,}", "ghp_[A-Za-z0-9]{20,}", "github_pat_[A-Za-z0-9_]{20,}")
TEXT_SUFFIXES = (".cff", ".css", ".html", ".ini", ".ipynb", ".json", ".md", ".py", ".toml", ".txt", ".yaml", ".yml")
MOST_TEXT = 5_000_000
TOOL_FOLDERS = (".git", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "build", "dist")


def classify(texts: DataFrame, key: str = "source_index", text: str = "safety_text") -> DataFrame:
    """decision (exclude before review before include), categories, reason, priority for each row."""
    excluded, review = T.matching_rules(F.col(text), V.EXCLUDE_RULES), T.matching_rules(F.col(text), V.REVIEW_RULES)
    rows = texts.select(key, excluded.alias("_x"), review.alias("_r"))
    decision = F.when(F.size("_x") > 0, "exclude").when(F.size("_r") > 0, "review").otherwise("include")
    categories = F.when(F.size("_x") > 0, F.col("_x")).otherwise(F.col("_r"))
    reason, priority = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name in V.PRIORITIES:
        reason = F.when(F.col("decision") == name, V.REASONS[name]).otherwise(reason)
        priority = F.when(F.col("decision") == name, V.PRIORITIES[name]).otherwise(priority)
    return rows.select(key, decision.alias("decision"), categories.alias("categories")).withColumns({"reason": reason, "priority": priority})


def counts(decisions: DataFrame) -> DataFrame:
    return decisions.agg(*(F.count_if(F.col("decision") == d).alias(d) for d in ("include", "exclude", "review")))


def included(rows: DataFrame, decisions: DataFrame, key: str = "source_index") -> DataFrame:
    """What may be published: rows whose decision is include. Derive all later results from this."""
    return rows.join(decisions.where("decision = 'include'").select(key), key, "left_semi")


def _glob(pattern: str) -> str:
    return "[^/]*".join(part.replace(".", "\\.") for part in pattern.split("*"))


def release_findings(files: DataFrame) -> DataFrame:
    """path, problem: files that a release must not hold, by folder, else by name, else by a credential in their text.

    files: path (parts joined by /), size_bytes, text. Text is looked at only where neither folder nor name decides.
    """
    parts = F.split("path", "/")
    within = lambda names: F.arrays_overlap(parts, F.lit(list(names)))
    base = F.element_at(parts, -1)
    readable = F.lower(F.regexp_extract(base, r".(\.[^.]+)$", 1)).isin(*TEXT_SUFFIXES) & (F.col("size_bytes") <= MOST_TEXT)
    named: Column = base.rlike("^(" + "|".join(map(_glob, RELEASE_NAMES)) + ")$")
    leaked = readable & F.col("text").rlike("(?<![A-Za-z0-9])(" + "|".join(CREDENTIALS) + ")")
    problem = F.when(within(RELEASE_FOLDERS), "private-artifact-directory").when(named, "private-artifact-name").when(leaked, "credential-pattern")
    return files.where(~within(TOOL_FOLDERS)).select("path", problem.alias("problem")).where("problem is not null")
