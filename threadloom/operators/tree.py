"""Operators on the message trees of conversations.

nodes: source_index, node_id, parent_node_id, declared (children that the source states; null: none stated), and more.
conversations: source_index, current_node_id. Everything is keyed by source_index: ids may repeat between conversations.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = ["source_index", "node_id"]


def canonical_children(nodes: DataFrame) -> DataFrame:
    """Each node's children by parent pointers, sorted; a node without any has an empty list."""
    by_parent = nodes.where("parent_node_id is not null").groupBy("source_index", F.col("parent_node_id").alias("node_id")).agg(F.sort_array(F.collect_list("node_id")).alias("children"))
    none = F.array().cast("array<string>")
    return nodes.select(*EDGE).join(by_parent, EDGE, "left").select(*EDGE, F.coalesce("children", none).alias("children"))


def dangling_parents(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent isn't in the conversation."""
    known = nodes.select("source_index", F.col("node_id").alias("parent_node_id"))
    return nodes.where("parent_node_id is not null").join(known, ["source_index", "parent_node_id"], "left_anti").select(*EDGE, "parent_node_id")


def edge_disagreement(nodes: DataFrame) -> DataFrame:
    """Per conversation: how declared children differ from those by parent pointers; only conversations that differ."""
    distinct = F.array_distinct("declared")
    stated = nodes.where("declared is not null").select(*EDGE, "declared").join(canonical_children(nodes), EDGE)
    own = stated.select(*EDGE, F.size(F.array_except("children", distinct)).alias("missing"), (F.size("declared") - F.size(distinct)).alias("duplicate"), F.lit(0).alias("conflicting"), F.lit(0).alias("dangling"))
    # A stated child that isn't one meets the nodes one by one: no node carries all ids of its conversation.
    extra = stated.select(*EDGE, F.explode(F.array_except(distinct, "children")).alias("child"))
    known = nodes.select("source_index", F.col("node_id").alias("child"), F.lit(1).alias("known")).distinct()
    extra = extra.join(known, ["source_index", "child"], "left").select(*EDGE, F.lit(0).alias("missing"), F.lit(0).alias("duplicate"), F.coalesce("known", F.lit(0)).alias("conflicting"), (1 - F.coalesce("known", F.lit(0))).alias("dangling"))
    kinds = ("missing", "conflicting", "dangling", "duplicate")
    counts = own.unionByName(extra).groupBy(*EDGE).agg(*(F.sum(c).alias(c) for c in kinds)).where("missing + conflicting + dangling + duplicate > 0")
    sums = [F.sum(c).alias(f"{c}_source_edges") for c in ("missing", "conflicting", "dangling", "duplicate")]
    return counts.groupBy("source_index").agg(F.count(F.lit(1)).alias("nodes_with_differences"), *sums)


_WALK = "source_index long, node_id string, path_pos int, reachable boolean, problem string"


def _walk(table: pa.Table) -> pa.Table:
    """One conversation: its current path from the root, which nodes a root reaches, and what stopped the path."""
    index, current = table.column("source_index")[0].as_py(), table.column("current_node_id")[0].as_py()
    parent = dict(zip(table.column("node_id").to_pylist(), table.column("parent_node_id").to_pylist()))
    path, problem, at = [], None, current
    if current is None:
        problem = "missing_current_node"
    elif current not in parent:
        problem = "unknown_current_node"
    else:
        seen = set()
        while at is not None:
            if at in seen:
                path, problem = [], "graph_cycle"
                break
            if at not in parent:
                problem = "dangling_parent"
                break
            seen.add(at)
            path.append(at)
            at = parent[at]
    position = {node: i for i, node in enumerate(reversed(path))}
    # A node is reachable if its chain of parents ends at a root; each chain is walked once.
    reachable: dict[str, bool] = {}
    for node in parent:
        chain, at = [], node
        while at is not None and at in parent and at not in reachable and at not in chain[-1:]:
            reachable[at] = False
            chain.append(at)
            at = parent[at]
        good = at is None or reachable.get(at, False)
        for x in chain:
            reachable[x] = good
    ids = list(parent)
    return pa.table({
        "source_index": pa.array([index] * len(ids), pa.int64()),
        "node_id": pa.array(ids, pa.string()),
        "path_pos": pa.array([position.get(x) for x in ids], pa.int32()),
        "reachable": pa.array([reachable[x] for x in ids], pa.bool_()),
        "problem": pa.array([problem] * len(ids), pa.string()),
    })


def walk(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per node: path_pos (null off the current path), reachable from a root, and the conversation's path problem.

    The chain of parents is a fold over one conversation, so one conversation is the unit of work; paths deeper than a
    recursive query's limit are ordinary.
    """
    both = nodes.select("source_index", "node_id", "parent_node_id").join(conversations.select("source_index", "current_node_id"), "source_index")
    return both.groupBy("source_index").applyInArrow(_walk, _WALK)


def visible_path(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    return walk(nodes, conversations).where("path_pos is not null").select(*EDGE, "path_pos")


def orphans(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per conversation with nodes that no root reaches: their number and the first 20 ids."""
    lost = walk(nodes, conversations).where("not reachable")
    return lost.groupBy("source_index").agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_list("node_id")), 1, 20).alias("sample"))


def path_messages(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes with a message on the current path, in order."""
    return nodes.where("role is not null").join(visible_path(nodes, conversations), EDGE)


def alternates(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages off the current path."""
    return nodes.where("role is not null").join(visible_path(nodes, conversations), EDGE, "left_anti")
