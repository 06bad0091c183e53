"""Atlases of other makers: alias keys, nested categories, profiles and relations to the book's relations.

A bounded document: a taxonomy is small, so it is read on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

# Fixed values. Keys under which a field may stand, the first that isn't null counts.
ALIASES = {
    "category": ("category_id", "id", "key", "slug"),
    "name": ("name", "title", "label", "display_name"),
    "description": ("description", "summary", "overview"),
    "parent": ("parent_id", "parent", "parent_category_id"),
    "children": ("children", "subcategories", "categories"),
    "members": ("conversation_keys", "conversations", "members"),
    "key": ("conversation_key", "key", "conversation_id", "id"),
    "primary": ("primary_category_id", "category_id", "category"),
    "others": ("secondary_category_ids", "secondary_categories"),
    "confidence": ("confidence", "score"),
    "source": ("source_key", "source", "from"),
    "target": ("target_key", "target", "to"),
    "similarity": ("similarity", "weight", "score"),
}


def first(record: Mapping, field: str):
    return next((record[k] for k in ALIASES[field] if record.get(k) is not None), None)


def text(value) -> str | None:
    return value.strip() or None if isinstance(value, str) else str(value) if isinstance(value, int | float) and not isinstance(value, bool) else None


def texts(value) -> list[str]:
    """Distinct texts of a list, in order; records stand for their key."""
    items = value if isinstance(value, list | tuple) else [] if value is None else [value]
    found = (text(first(v, "key")) if isinstance(v, Mapping) else text(v) for v in items)
    return list(dict.fromkeys(x for x in found if x))


def number(value) -> float | None:
    try:
        out = float(value) if not isinstance(value, bool) else None
    except (TypeError, ValueError):
        return None
    return out if out is not None and out == out and abs(out) != float("inf") else None


def flatten(records: Iterable, parent: str | None = None) -> list[tuple]:
    """(category, parent, name, description, members) of nested or flat categories, each id once."""
    out: dict[str, tuple] = {}
    todo = [(r, parent) for r in records]
    while todo:
        record, above = todo.pop(0)
        if not isinstance(record, Mapping) or (identity := text(first(record, "category"))) is None:
            continue
        children = first(record, "children") or []
        if identity not in out:
            out[identity] = (identity, text(first(record, "parent")) or above, text(first(record, "name")) or identity, text(first(record, "description")), texts(first(record, "members")))
            todo = [(c, identity) for c in children if isinstance(c, Mapping)] + todo
    return list(out.values())


def _records(root: Mapping, *names: str) -> list:
    for n in names:
        value = root.get(n)
        if isinstance(value, list):
            return value
        if isinstance(value, Mapping):
            return [v | {"id": k} if isinstance(v, Mapping) and first(v, "category") is None else v for k, v in value.items()]
    return []


def relations(spark: SparkSession, root: Mapping) -> dict[str, DataFrame]:
    """categories, membership, catalog and edges of an atlas document."""
    taxonomy = root.get("taxonomy") if isinstance(root.get("taxonomy"), Mapping) else root
    rows = flatten(_records(taxonomy, "categories", "nodes", "tree"))
    catalog, edges = [], []
    for r in _records(root, "catalog", "assignments", "conversations"):
        if isinstance(r, Mapping) and (key := text(first(r, "key"))):
            catalog.append((key, text(first(r, "primary")), texts(first(r, "others")), number(first(r, "confidence"))))
    for r in _records(root, "edges", "graph", "relations"):
        if isinstance(r, Mapping) and text(first(r, "source")) and text(first(r, "target")):
            edges.append((text(first(r, "source")), text(first(r, "target")), number(first(r, "similarity"))))
    return {
        "categories": spark.createDataFrame([r[:4] for r in rows], "category string, parent string, name string, description string"),
        "membership": spark.createDataFrame([(k, r[0]) for r in rows for k in r[4]], "key string, category string"),
        "catalog": spark.createDataFrame(catalog, "entry string, primary string, others array<string>, confidence double"),
        "edges": spark.createDataFrame(edges, "source_key string, target_key string, similarity double"),
    }
