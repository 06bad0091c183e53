"""Dossiers, alias parsing, records, providers, costs: small checks."""

from __future__ import annotations

import hashlib
import json
import random
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions import vectors
from threadloom.operators import cost, evaluate, figures, longitudinal, simgraph, taxonomy, tree
from threadloom.plans import dossier, providers, records
from threadloom.plans import fixtures as X
from threadloom.sources import atlas_json, manifests


def test_aliases_and_nesting(spark):
    root = {"taxonomy": {"categories": [{"id": "a", "title": "A", "subcategories": [{"slug": "b", "label": "B", "members": [{"id": "k1"}, "k1", "k2"]}]}, {"name": "no id"}, {"id": "a"}]}, "assignments": {"k1": {"category": "b", "score": "0.5"}}, "edges": [{"from": "k1", "to": "k2", "weight": 1}, {"from": "k1"}]}
    got = atlas_json.relations(spark, root)
    assert [tuple(r) for r in got["categories"].collect()] == [("a", None, "A", None), ("b", "a", "B", None)]
    assert [tuple(r) for r in got["membership"].collect()] == [("k1", "b"), ("k2", "b")]
    assert [tuple(r) for r in got["catalog"].collect()] == [("k1", "b", [], 0.5)]
    assert got["edges"].count() == 1


def test_records(spark):
    rows = [("i1", "s", [], "unreviewed"), (None, "s", [("c", "t", None, "e", "r", "guess", None, None, None)], None), ("i3", "s", [("c", "t", None, "x" * 3000, "r", "heuristic", None, None, None)], None)]
    got = records.faults(spark.createDataFrame(rows, records.RECORDS["insight"]), "insight").collect()
    assert sorted((str(r["id"]), r["fault"]) for r in got) == [("None", "no id"), ("None", "unknown kind in evidence"), ("i1", "no evidence"), ("i3", "long excerpt in evidence")]


def test_corrections(tmp_path):
    path = tmp_path / "log.json"
    dossier.append_correction(path, dossier.correction("t", "rename", "a", "b"))
    assert len(dossier.append_correction(path, dossier.correction("t", "rename", "b", "c"))) == 2
    assert [e["after"] for e in json.loads(path.read_text())] == ["b", "c"]


def best_by_modularity(nodes, weights):
    """One sequential sweep after another; a move's worth is the modularity of all nodes, computed from scratch."""
    home, total = {n: n for n in nodes}, sum(sum(w.values()) for w in weights.values())
    strength = {n: sum(weights[n].values()) for n in nodes}

    def modularity():
        inside = sum(w for a in nodes for b, w in weights[a].items() if home[a] == home[b])
        masses = defaultdict(float)
        for n in nodes:
            masses[home[n]] += strength[n]
        return inside / total - sum((m / total) ** 2 for m in masses.values())

    moved = True
    while moved:
        moved = False
        for n in nodes:
            old, tried = home[n], {}
            for c in sorted({home[b] for b in weights[n]} | {old}):
                home[n] = c
                tried[c] = modularity()
            best = max(tried.values())
            home[n] = old
            if best > tried[old] + 1e-9:
                home[n] = min(c for c, q in tried.items() if q > best - 1e-9)
                moved = True
    return home


@pytest.mark.parametrize("seed", range(3))
def test_communities_against_one_sweep(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = {tuple(sorted(rng.sample(nodes, 2))): round(rng.uniform(0.3, 1), 3) for _ in range(55)}
    weights = defaultdict(dict)
    for (a, b), w in sorted(edges.items()):
        weights[a][b] = weights[b][a] = w
    linked = sorted(weights)
    home = best_by_modularity(linked, weights)
    groups = defaultdict(list)
    for n in nodes:
        groups[home.get(n, n)].append(n)
    want = {n: f"category-{k:04d}" for k, g in enumerate(sorted(groups.values()), 1) for n in g}
    keys = spark.createDataFrame([(n,) for n in nodes], "key string")
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "source_key string, target_key string, similarity double")
    assert {r["key"]: r["category"] for r in simgraph.communities(keys, frame).collect()} == want


def test_two_cliques_are_two_communities(spark):
    edges = [(a, b, 0.9) for g in ("abc", "xyz") for a in g for b in g if a < b] + [("c", "x", 0.35)]
    keys = spark.createDataFrame([(k,) for k in "abcxyz"], "key string")
    got = {r["key"]: r["category"] for r in simgraph.communities(keys, spark.createDataFrame(edges, "source_key string, target_key string, similarity double")).collect()}
    assert got == {k: "category-0001" if k in "abc" else "category-0002" for k in "abcxyz"}
    none = spark.createDataFrame([], "source_key string, target_key string, similarity double")
    assert {r["category"] for r in simgraph.communities(keys, none).collect()} == {f"category-000{i}" for i in range(1, 7)}


def test_groups_of_centroids():
    rng = np.random.default_rng(1)
    centres = np.eye(8)[:3]
    points = np.repeat(centres, 4, axis=0) + rng.normal(0, 0.01, (12, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    want = [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    assert sorted(simgraph.farthest_first(points, 3)) == want and sorted(simgraph.average_linkage(points, 3)) == want
    assert simgraph.farthest_first(points[:2], 3) == [[0], [1]]


@pytest.mark.parametrize("seed", range(4))
def test_average_linkage_against_brute_force(seed, monkeypatch):
    points = np.random.default_rng(seed).normal(size=(24, 5))
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    for count in (1, 2, 7, 24):
        groups = [[i] for i in range(len(points))]
        while len(groups) > count:
            a, b = min(((a, b) for b in range(len(groups)) for a in range(b)), key=lambda x: apart[np.ix_(groups[x[0]], groups[x[1]])].mean())
            groups[a] += groups.pop(b)
        assert sorted(simgraph.average_linkage(points, count)) == sorted(map(sorted, groups))
    monkeypatch.setattr(simgraph, "MOST_LINKED", 23)
    with pytest.raises(ValueError):
        simgraph.average_linkage(points, 2)


@pytest.mark.parametrize("method", ["farthest_first", "average"])
def test_consolidation(spark, method):
    rng = np.random.default_rng(3)
    rows = [(f"k{i:02d}", (np.eye(6)[i % 6] + (0.5 * np.eye(6)[(i % 6) // 2 * 2]) + rng.normal(0, 0.01, 6)).tolist(), f"c{i % 6}") for i in range(30)]
    frame = spark.createDataFrame(rows, "key string, vector array<double>, category string")
    got = simgraph.consolidate(frame.select("key", "vector"), frame.select("key", "category"), 3, method).collect()
    assert {(r["key"], r["category"], r["source_communities"]) for r in got} == {(f"k{i:02d}", f"category-{(i % 6) // 2 + 1:04d}", 2) for i in range(30)}


def test_neighbours_across_blocks(spark, monkeypatch):
    rows = [(f"k{i:02d}", v.tolist()) for i, v in enumerate(np.random.default_rng(5).normal(size=(30, 6)))]
    frame = spark.createDataFrame(rows, "key string, vector array<double>")
    whole = {(r["node"], r["other"]): round(r["similarity"], 9) for r in simgraph.neighbours(frame, 0.1, 4).collect()}
    monkeypatch.setattr(simgraph, "BLOCK", 7)
    assert {(r["node"], r["other"]): round(r["similarity"], 9) for r in simgraph.neighbours(frame, 0.1, 4).collect()} == whole


def brute_candidates(rows, dimensions, limit, retained):
    """Node by node, as the reference describes it."""
    n, d = len(rows), len(rows[0][1])
    coarse = sorted({min(d - 1, k * d // 48) for k in range(min(48, d))})
    signs = [{(i, v[i] >= 0) for i in sorted(range(d), key=lambda i: (-abs(v[i]), i))[:dimensions]} for _, v in rows]
    pairs = set()
    for i, (_, v) in enumerate(rows):
        found = {j for j in range(n) if j != i and signs[i] & signs[j]}
        offset = 1
        while len(found) < min(limit, n - 1):
            found |= {(i + offset * 104_729) % n} - {i}
            offset += 1
        best = sorted(found, key=lambda j: (-sum(v[k] * rows[j][1][k] for k in coarse), rows[j][0]))[:retained]
        pairs |= {tuple(sorted((rows[i][0], rows[j][0]))) for j in best}
    return pairs


@pytest.mark.parametrize("dimensions", [1, 4])
def test_bucket_candidates_against_brute_force(spark, monkeypatch, dimensions):
    values = np.random.default_rng(6).integers(-50, 50, size=(90, 60)).astype(float)
    # A vector whose one large dimension no other has.
    values[:, 59], values[7, 59] = 0, 1000
    rows = [(f"k{i:02d}", v.tolist()) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "key string, vector array<double>").repartition(3)
    monkeypatch.setattr(simgraph, "BLOCK", 40)
    got = [tuple(r) for r in simgraph.bucket_candidates(frame, dimensions, 4, 16).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_candidates(rows, dimensions, 32, 16)
    assert any("k07" in pair for pair in got)
    assert simgraph.bucket_candidates(frame, dimensions, 4, 90).count() == 90 * 89 // 2


def test_hash_embedding(spark):
    frame = spark.createDataFrame([("a", "Alpha tool", "alpha beta beta"), ("b", "", ""), ("c", "Alpha tool", "alpha beta beta")], "k string, title string, text string")
    got = {r["key"]: np.array(r["vector"]) for r in vectors.hash_embeddings(frame, "k", F.col("title"), F.col("text"), 64).collect()}
    assert np.isclose(np.linalg.norm(got["a"]), 1) and not got["b"].any() and (got["a"] == got["c"]).all() and len(got["a"]) == 64


def test_hash_embedding_against_brute_force(spark):
    """Every vector of the smallest table, feature by feature."""
    rows = X.items(spark, "/root/testdata/sf0.001").select("conversation_key", "title", "text", T.tokens(F.col("title")).alias("own"), T.tokens(F.col("text")).alias("said"))
    got = {r["key"]: np.array(r["vector"]) for r in vectors.hash_embeddings(rows, "conversation_key", F.col("title"), F.col("text"), 128).collect()}
    assert len(got) == rows.count() > 100
    for r in rows.collect():
        want = np.zeros(128)
        for feature in [*r["own"], *r["own"], *r["said"], *(f"{a}::{b}" for a, b in zip(r["said"], r["said"][1:]))]:
            digest = hashlib.blake2b(feature.encode(), digest_size=16).digest()
            want[int.from_bytes(digest[:8], "big") % 128] += 1 if digest[8] & 1 else -1
        assert np.allclose(got[r["conversation_key"]], want / (np.linalg.norm(want) or 1))


def test_names_stay_unique(spark):
    drafts = spark.createDataFrame([("c1", ["A", "B", "C"]), ("c2", ["a", "b", "D"]), ("c3", ["A", "B"]), ("c4", [])], "category string, labels array<string>")
    got = {r["category"]: r["name"] for r in taxonomy.interpret(drafts).collect()}
    assert got == {"c1": "A · B", "c2": "a · b · D", "c3": "A · B · related thread", "c4": "Unclassified conversations"}
    with pytest.raises(ValueError):
        taxonomy.interpret(drafts, most=3)


def test_deep_and_cyclic_paths(spark):
    rows = [(1, f"n{i}", f"n{i - 1}" if i else None) for i in range(500)] + [(2, "a", "b"), (2, "b", "a"), (3, "x", "gone"), (4, "r", None)]
    nodes = spark.createDataFrame(rows, "source_index long, node_id string, parent_node_id string")
    talks = spark.createDataFrame([(1, "n499"), (2, "a"), (3, "x"), (4, None)], "source_index long, current_node_id string")
    got = tree.walk(nodes, talks)
    assert got.where("source_index = 1").agg(F.max("path_pos")).first()[0] == 499
    problems = {r["source_index"]: r["problem"] for r in got.collect()}
    assert problems == {1: None, 2: "graph_cycle", 3: "dangling_parent", 4: "missing_current_node"}
    assert tree.visible_path(nodes, talks).where("source_index in (2, 4)").isEmpty()
    assert {r["source_index"]: r["n"] for r in tree.orphans(nodes, talks).collect()} == {2: 2, 3: 1}


def test_text_functions(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c(F.col("t")).alias("r")).first()["r"]
    assert one(T.title_case, "it's a-b c3po x_y") == "It'S A-B C3Po X_Y"
    assert one(T.normalize_lines, " a \t b\r\nc d e ") == "a b\nc\nd\n\ne"
    assert one(lambda c: T.truncate_middle(c, 100), "x" * 101).startswith("x" * 26 + "\n\n[...") and len(one(lambda c: T.truncate_middle(c, 100), "x" * 101)) == 100
    assert one(T.sentences, "One. Two! Three? ") == ["One.", "Two!", "Three?"]
    assert one(T.escape_markdown, "a*b_c") == "a\\*b\\_c"
    assert one(lambda c: T.redact(c, [("(a+)", r"<\1$>")]), "caat") == "c<aa$>t"
    assert one(T.escape_pointer, "a~b/c") == "a~0b~1c"


def test_ledger(spark, tmp_path):
    path = tmp_path / "ledger.json"
    ledger = cost.Ledger(Decimal(10), path)
    ledger.reserve("a", Decimal(6))
    with pytest.raises(ValueError):
        ledger.reserve("b", Decimal(5))
    ledger.settle("a", Decimal(4))
    ledger.reserve("b", Decimal(5))
    # A failed request may have been billed: its reservation stays charged.
    ledger.fail("b")
    with pytest.raises(ValueError):
        cost.Ledger(Decimal(20), path)
    ledger = cost.Ledger(Decimal(20), path, allow_increase=True)
    with pytest.raises(ValueError):
        ledger.raise_ceiling(Decimal(30))
    row = cost.ledger_snapshot(ledger.table(spark), ledger.ceiling).first()
    assert (row["charged"], row["remaining"], row["completed"], row["unsettled"]) == (9, 11, 1, 1)
    assert cost.Ledger(Decimal(20), path).charged == 9
    ledger.reserve("c", Decimal(1))
    ledger.settle("c", None)
    with pytest.raises(ValueError):
        ledger.settle("c", Decimal(1))
    ledger.reserve("d", Decimal(10))
    with pytest.raises(ValueError):
        ledger.settle("d", Decimal(11))
    assert cost.Ledger(Decimal(20), path).entries["d"]["state"] == "completed"
    path.write_text("[]")
    with pytest.raises(ValueError):
        cost.Ledger(Decimal(20), path)


@pytest.mark.parametrize(("count", "most_items", "most_tokens", "ranges"), [(50, 4, 100, 1), (300, 4, 100, 8), (300, 40, 900, 16), (60, 100, 10_000, 16), (200, 1, 5, 4), (120, 7, 30, 5)])
def test_request_batches(spark, count, most_items, most_tokens, ranges):
    rng = random.Random(count)
    tokens = [rng.choice([0, rng.randrange(1, 60), 2 * most_tokens if rng.random() < 0.1 else 3]) for _ in range(count)]
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = cost.request_batches(spark.createDataFrame(list(enumerate(tokens)), "position long, tokens long"), most_items, most_tokens).orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want, batch, n, total = [], 0, 0, 0
    for t in tokens:
        if n and (n == most_items or total + t > most_tokens):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + t
        want.append(batch)
    assert [r["batch"] for r in got] == want and [r["tokens"] for r in got] == tokens


def test_no_request_batches(spark):
    assert cost.request_batches(spark.createDataFrame([], "position long, tokens long"), 4, 100).collect() == []
    assert [tuple(r) for r in cost.request_batches(spark.createDataFrame([(7, None)], "position long, tokens long"), 4, 100).collect()] == [(7, 0, 0)]


def test_token_window(spark):
    rows = [("a", 0, 5), ("a", 59, 5), ("a", 60, 5), ("b", 60, 11)]
    frame = spark.createDataFrame(rows, "client string, s int, tokens int").select("client", "s", F.timestamp_seconds("s").alias("at"), "tokens")
    got = [(r["client"], r["s"], r["used"], r["fits"]) for r in cost.token_window(frame, 10).orderBy("client", "s").collect()]
    assert got == [("a", 0, 5, True), ("a", 59, 10, True), ("a", 60, 10, True), ("b", 60, 11, False)]


def test_work_has_bounds(spark):
    sizes = {"leaf_categories": 2, "refined_per_category": 3, "most_refined": 0, "batch": 8, "embedding_tokens": 9, "profile_tokens": 9, "profile_reply": 9, "taxonomy_reply": 9, "synthesis_reply": 9}
    none = spark.createDataFrame([(0, 0)], "items long, approximate_tokens long")
    price = cost.Price(Decimal(1), Decimal(1))
    row = cost.scheduled_plan(none, price, price, price, price, cost.Work(**sizes), Decimal(1)).first()
    assert (row["refined_count"], row["profile_requests"], row["embedding_tokens"], row["structured_input_tokens"], row["fits"]) == (0, 0, 0, 2000 + 1400 + 3000 + 2200, True)
    with pytest.raises(ValueError):
        cost.Work(**sizes | {"batch": 0})


def test_cached_embeddings(spark, tmp_path):
    calls = []

    class Counting(providers.LocalEmbeddings):
        def embed(self, items):
            calls.append(items.count())
            return super().embed(items)

    items = X.items(spark, "/root/testdata/sf0.001").limit(10).withColumn("text_sha256", F.sha2("text", 256))
    folder = str(tmp_path / "cache")
    first = providers.cached_embeddings(items, Counting(64), folder)
    again = providers.cached_embeddings(items, Counting(64), folder)
    assert calls == [10, 0] and sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    with pytest.raises(ValueError):
        providers.LocalEmbeddings(8)
    with pytest.raises(ValueError):
        providers.covered(items, "conversation_key", first.limit(3), "key")


def test_cached_profiles(spark, tmp_path):
    calls = []

    class Each:
        name, model = "each", "1"

        def analyze(self, items):
            calls.append(items.count())
            return items.select("conversation_key", "position", F.col("title").alias("synopsis"), F.array("lang").alias("projects"))

    items = X.items(spark, "/root/testdata/sf0.001").orderBy("source_index").limit(10).withColumn("text_sha256", F.sha2("text", 256))
    folder = str(tmp_path / "profiles")
    some = providers.cached_profiles(items.limit(6), Each(), folder)
    first = providers.cached_profiles(items, Each(), folder)
    again = providers.cached_profiles(items, Each(), folder)
    assert calls == [6, 4, 0] and some.count() == 6
    assert first.columns == again.columns == some.columns and sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    moved = providers.cached_profiles(items.withColumn("position", F.col("position") + 5), Each(), folder)
    assert calls[-1] == 0 and {r["position"] for r in moved.collect()} == set(range(6, 16))
    assert providers.cached_profiles(items, providers.LocalAnalyses(), folder + "-local").count() == 10 and not (tmp_path / "profiles-local").exists()


def test_evaluation(spark):
    truth = spark.createDataFrame([("t1", i) for i in range(10)] + [("t2", i) for i in range(10, 14)], "name string, member int")
    found = spark.createDataFrame([("p1", i) for i in range(5)] + [("p2", i) for i in range(5, 12)], "name string, member int")
    overlaps = evaluate.jaccard(truth, found)
    best = {r["truth"]: (r["inferred"], r["matched"]) for r in evaluate.best_matches(overlaps).collect()}
    assert best == {"t1": ("p1", True), "t2": ("p2", True)}
    # p2 shares members with both, but the best of t1 is p1: nothing is merged.
    assert evaluate.fragments(overlaps).first().asDict() == {"fragmented": 1, "merged": 0}
    both = spark.createDataFrame([("t1", "p", 0.3), ("t1", "q", 0.3), ("t2", "q", 0.12), ("t3", "q", 0.11)], "truth string, inferred string, overlap double")
    known = spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t4",)], "name string")
    assert sorted(map(tuple, evaluate.verdicts(known, both).collect())) == [("fragmented", "t1"), ("merged", "q"), ("missed", "t2"), ("missed", "t3"), ("missed", "t4")]
    figures_row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in {"timelines": 4, "matched": 4, "temporal": 5, "open_loops": 4, "dormant": 1, "reversals": 2, "connections": 4, "duplicate_names": 0, "generic_names": 0, "evidence_failures": 0, "unsupported": 0}.items()))
    assert [r["condition"] for r in evaluate.acceptance(figures_row).where("not passed").collect()] == ["dormant"]


def test_dormancy_and_sampling(spark):
    rows = [("p", 1), ("p", 30), ("p", 105), ("q", 1), ("q", 75), ("r", 1)]
    members = spark.createDataFrame(rows, "project string, d int").select("project", F.expr("timestamp '2024-01-01' + make_dt_interval(d)").alias("at"))
    assert [r["project"] for r in longitudinal.dormant(members).collect()] == ["p"]
    many = spark.range(40).select(F.lit("g").alias("g"), "id")
    assert sorted(r["place"] for r in longitudinal.evenly_spaced(many, "g", [F.col("id")]).collect()) == sorted({round(i * 39 / 11) for i in range(12)})


def test_aliases_of_projects(spark):
    frame = spark.createDataFrame([(f"p{i:02d}",) for i in range(28)], "project string")
    got = {r["project"]: r["alias"] for r in figures.aliases(frame, "project").collect()}
    assert (got["p00"], got["p25"], got["p26"]) == ("Project A", "Project Z", "Project 27")


def test_manifest_refuses_to_climb(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    listed = [r.asDict() for r in manifests.artifacts(spark, tmp_path).collect()]
    assert manifests.verify(spark, tmp_path, listed).isEmpty()
    bad = manifests.verify(spark, tmp_path, [*listed, {"path": "../a", "size_bytes": 1, "sha256": "x"}]).collect()
    assert [(r["path"], r["problem"]) for r in bad] == [("../a", "unsafe")]
    assert manifests.same_run({"x": 1, "ceiling": 5}, {"x": 1, "ceiling": 4}, ["x", "ceiling"]) == []
    assert manifests.same_run({"x": 2, "ceiling": 3}, {"x": 1, "ceiling": 4}, ["x", "ceiling"]) == ["x", "ceiling"]
