"""Similarity graphs: neighbours by cosine, components, communities, consolidation.

vectors: key, vector (array of double). Edges are undirected rows (source_key, target_key, similarity), ends sorted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators.order import running
from threadloom.plans.session import settled

#: Vectors on either side of one task's matrix product.
BLOCK = 2048
#: Positions between the vectors that fill up a node's candidates.
STRIDE = 104_729


def cosine(a, b):
    """Of two array columns; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def check_vectors(vectors: DataFrame) -> DataFrame:
    """One row: rows, distinct keys, least and most dimensions, vectors that aren't finite."""
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.count_if(odd).alias("odd"))


def top_dimensions(vector, count: int):
    """Places of the largest absolute values, ties by place."""
    ranked = F.array_sort(F.transform(vector, lambda v, i: F.struct((-F.abs(v)).alias("a"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, count), lambda x: x["i"])


def neighbours(vectors: DataFrame, min_similarity: float, k: int | None) -> DataFrame:
    """node, other, similarity: for each node its k most similar others above the bound (ties by key); None: all.

    Exact. Vectors are dealt into blocks; a task multiplies two blocks and passes on at most k candidates a node, so
    neither rows nor memory grow with the number of pairs.
    """
    n = vectors.count()
    blocks = max(1, -(-n // BLOCK))
    mine = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    dealt = vectors.select("key", F.col("vector").cast("array<double>").alias("vector"), mine.alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("key", "vector", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def multiply(table: pa.Table) -> pa.Table:
        keys = np.array(table.column("key").to_pylist(), dtype=object)
        matrix = np.array(table.column("vector").to_pylist(), dtype=np.float64)
        own = table.column("own").to_numpy()
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        norms = np.linalg.norm(matrix, axis=1)
        unit = matrix / np.where(norms == 0, 1, norms)[:, None]
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        node, other, value = [], [], []
        for a, b in ((left, right),) if x == y else ((left, right), (right, left)):
            if not len(a) or not len(b):
                continue
            similarity = np.clip(unit[a] @ unit[b].T, -1.0, 1.0)
            for i, row in zip(a, similarity):
                good = np.flatnonzero((row >= min_similarity) & (b != i))
                order = sorted(good, key=lambda j: (-row[j], keys[b[j]]))[:k]
                node += [keys[i]] * len(order)
                other += [keys[b[j]] for j in order]
                value += [float(row[j]) for j in order]
        return pa.table({"node": pa.array(node, pa.string()), "other": pa.array(other, pa.string()), "similarity": pa.array(value, pa.float64())})

    found = dealt.groupBy("x", "y").applyInArrow(multiply, "node string, other string, similarity double")
    if k is None:
        return found
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("similarity"), "other"))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def bucket_candidates(vectors: DataFrame, dimensions: int = 12, max_neighbors: int = 10, brute_force: int = 256) -> DataFrame:
    """a, b: candidate pairs that share a large dimension and its sign, the best per node by coarse similarity.

    The approximate alternative to neighbours(), with the reference's limits: a node with fewer than 8 * max_neighbors
    (at least 32) mates gets others at strides of STRIDE positions in the order of keys, and the best 4 * max_neighbors
    (at least 16) stay. Up to `brute_force` vectors, all pairs. Blocks as in neighbours().
    """
    keys = vectors.select("key")
    n = vectors.count()
    if n <= brute_force:
        return keys.select(F.col("key").alias("a")).join(keys.select(F.col("key").alias("b")), F.col("a") < F.col("b"))
    wanted, retained = min(max(8 * max_neighbors, 32), n - 1), max(4 * max_neighbors, 16)
    # A stride that shares a factor with n would come round too early; the reference doesn't end there.
    stride = next(s for s in range(STRIDE, STRIDE + n) if math.gcd(s, n) == 1)
    # Fewer than `wanted` of these are mates, so enough are left.
    offsets = np.arange(1, min(n - 1, 2 * wanted) + 1, dtype=np.int64)
    blocks = -(-n // BLOCK)
    # The order is global by definition; keys only are ranked, range by range.
    placed = vectors.join(running(keys, ["key"], settled).select("key", F.col("place").cast("long").alias("place")), "key")
    dealt = placed.select("key", "place", F.col("vector").cast("array<double>").alias("vector"), (F.col("place") % blocks).cast("int").alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("key", "place", "vector", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def meet(table: pa.Table) -> pa.Table:
        """For a node: its best mates in a block, with their number there, and those at its strides, with the step."""
        keys = np.array(table.column("key").to_pylist(), dtype=object)
        matrix = np.array(table.column("vector").to_pylist(), dtype=np.float64)
        own, place = table.column("own").to_numpy(), table.column("place").to_numpy()
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        d = matrix.shape[1]
        coarse = matrix[:, sorted({min(d - 1, k * d // 48) for k in range(min(48, d))})]
        top = np.argsort(-np.abs(matrix), axis=1, kind="stable")[:, :dimensions]
        signs = np.zeros((len(matrix), 2 * d), dtype=np.float32)
        rows = np.arange(len(matrix))[:, None]
        signs[rows, 2 * top + (matrix[rows, top] >= 0)] = 1
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        out: list[tuple] = []
        for a, b in ((left, right),) if x == y else ((left, right), (right, left)):
            if not len(a) or not len(b):
                continue
            at = {int(p): k for k, p in enumerate(place[b])}
            scores, shared = coarse[a] @ coarse[b].T, signs[a] @ signs[b].T > 0
            for i, score, mate in zip(a, scores, shared):
                mates = np.flatnonzero(mate & (b != i))
                near = mates
                if len(mates) > retained:
                    near = mates[score[mates] >= np.partition(score[mates], -retained)[-retained]]
                best = sorted(near, key=lambda k: (-score[k], keys[b[k]]))[:retained]
                out += [(keys[i], keys[b[k]], float(score[k]), len(mates) if r == 0 else 0, 0) for r, k in enumerate(best)]
                if len(mates) >= wanted:
                    continue
                for step, p in zip(offsets.tolist(), ((place[i] + offsets * stride) % n).tolist()):
                    k = at.get(p)
                    if k is not None and b[k] != i and not mate[k]:
                        out.append((keys[i], keys[b[k]], float(score[k]), 0, step))
        types = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
        columns = list(zip(*out)) or [()] * len(types)
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("node", "other", "score", "mates", "step"), columns, types)})

    met = dealt.groupBy("x", "y").applyInArrow(meet, "node string, other string, score double, mates long, step long")
    node = Window.partitionBy("node")
    # Mates have step 0. Of the others, as many as are missing, by step.
    lacking = F.lit(wanted) - F.sum("mates").over(node)
    nth = F.row_number().over(Window.partitionBy("node", F.col("step") > 0).orderBy("step"))
    filled = met.withColumn("lacking", lacking).withColumn("nth", nth).where("step = 0 or nth <= lacking")
    rank = F.row_number().over(node.orderBy(F.desc("score"), "other"))
    best = filled.withColumn("_r", rank).where(F.col("_r") <= retained)
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def similarity_graph(vectors: DataFrame, min_similarity: float = 0.32, k: int = 10) -> DataFrame:
    """An edge wherever either end has chosen the other; its similarity is the larger of the two."""
    chosen = neighbours(vectors, min_similarity, k)
    ends = chosen.select(F.least("node", "other").alias("source_key"), F.greatest("node", "other").alias("target_key"), "similarity")
    return ends.groupBy("source_key", "target_key").agg(F.max("similarity").alias("similarity"))


def shared_signals(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Up to six labels that both ends of an edge have, compared by lower case, spelled as the source does."""
    one = labels.groupBy("conversation_key", F.lower("label").alias("folded")).agg(F.max("label").alias("label"))
    source = one.select(F.col("conversation_key").alias("source_key"), "folded", "label")
    target = one.select(F.col("conversation_key").alias("target_key"), "folded")
    both = edges.select("source_key", "target_key").join(source, "source_key").join(target, ["target_key", "folded"])
    ordered = F.slice(F.array_sort(F.collect_list(F.struct("folded", "label"))), 1, 6)
    found = both.groupBy("source_key", "target_key").agg(F.transform(ordered, lambda x: x["label"]).alias("shared_signals"))
    return edges.join(found, ["source_key", "target_key"], "left").withColumn("shared_signals", F.coalesce("shared_signals", F.array().cast("array<string>")))


def both_ways(edges: DataFrame) -> DataFrame:
    """node, other, similarity in either direction."""
    return edges.select(F.col("source_key").alias("node"), F.col("target_key").alias("other"), "similarity").unionByName(edges.select(F.col("target_key").alias("node"), F.col("source_key").alias("other"), "similarity"))


def degrees(edges: DataFrame) -> DataFrame:
    """Per connected node: number of edges and their weight."""
    return both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("similarity").alias("weight"))


def isolated(keys: DataFrame, edges: DataFrame) -> DataFrame:
    return keys.select("key").join(both_ways(edges).select(F.col("node").alias("key")).distinct(), "key", "left_anti")


def components(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """key, component: the smallest key that it reaches, by passing labels and jumping along them."""
    links = settled(both_ways(edges).select("node", "other"))
    state = settled(keys.select("key", F.col("key").alias("component")))
    while True:
        offered = links.join(state.select(F.col("key").alias("other"), "component"), "other").groupBy(F.col("node").alias("key")).agg(F.min("component").alias("offer"))
        hooked = settled(state.join(offered, "key", "left").select("key", F.least("component", F.coalesce("offer", "component")).alias("low"), F.col("component").alias("was")))
        ahead = hooked.select(F.col("key").alias("low"), F.col("low").alias("next"))
        jumped = settled(hooked.join(ahead, "low").select("key", F.least("low", "next").alias("component"), "was"))
        state = jumped.select("key", "component")
        if jumped.where("component <> was").isEmpty():
            return state


def _sweep(first: np.ndarray, other: np.ndarray, weight: np.ndarray, total: float, resolution: float, passes: int) -> np.ndarray:
    """Communities of nodes 0, 1, ..., named by one of their nodes: in turn, each joins the neighbouring one that raises
    modularity most, the smallest name first, until a pass changes nothing.

    Node v's links are the places first[v] to first[v + 1] of `other` and `weight`.
    """
    n = len(first) - 1
    home = np.arange(n)
    strength = np.bincount(np.repeat(home, np.diff(first)), weights=weight, minlength=n)
    mass = strength.copy()
    for _ in range(passes):
        before = home.copy()
        for v in np.flatnonzero(strength):
            links = slice(first[v], first[v + 1])
            near, which = np.unique(np.append(home[other[links]], home[v]), return_inverse=True)
            mass[home[v]] -= strength[v]
            gain = np.bincount(which, weights=np.append(weight[links], 0.0)) - resolution * mass[near] * strength[v] / total
            if gain.max() > gain[which[-1]] + 1e-12:
                home[v] = near[gain.argmax()]
            mass[home[v]] += strength[v]
        if (home == before).all():
            break
    return home


def communities(keys: DataFrame, edges: DataFrame, resolution: float = 1.0, passes: int = 40) -> DataFrame:
    """key, category: communities by sequential modularity moves, numbered by their smallest member.

    A move depends on neighbours' labels and the graph's total weight only, so each connected component runs on its own
    with that total: the same result as one sequential sweep over all nodes.
    """
    edges = settled(edges)
    total = edges.agg(F.sum("similarity").alias("s")).first()["s"] or 0.0
    parts = components(keys, edges)
    linked = edges.join(parts.select(F.col("key").alias("source_key"), "component"), "source_key")

    def run(table: pa.Table) -> pa.Table:
        ends = pa.concat_arrays([table.column(c).combine_chunks() for c in ("source_key", "target_key")])
        nodes, places = np.unique(np.array(ends.to_pylist(), dtype=object), return_inverse=True)
        n = table.num_rows
        row, other = places, np.append(places[n:], places[:n])
        order = np.lexsort((other, row))
        first = np.searchsorted(row[order], np.arange(len(nodes) + 1))
        weight = np.tile(table.column("similarity").to_numpy(), 2)[order]
        home = _sweep(first, other[order], weight, 2 * total, resolution, passes)
        return pa.table({"key": pa.array(nodes.tolist(), pa.string()), "home": pa.array(nodes[home].tolist(), pa.string())})

    homes = linked.groupBy("component").applyInArrow(run, "key string, home string") if total > 0 else keys.select("key", F.col("key").alias("home")).limit(0)
    every = keys.select("key").join(homes, "key", "left").select("key", F.coalesce("home", "key").alias("home"))
    first = every.groupBy("home").agg(F.min("key").alias("first"))
    number = running(first, ["first"], settled).withColumn("category", F.format_string("category-%04d", F.col("place") + 1))
    return every.join(number, "home").select("key", "category")


def centroids(vectors: DataFrame, membership: DataFrame) -> DataFrame:
    """category, centroid: the mean of the members' vectors, scaled to length 1 (a mean of length 0 stays)."""
    rows = vectors.join(membership, "key").select("category", F.posexplode(F.col("vector").cast("array<double>")).alias("pos", "v"))
    means = rows.groupBy("category", "pos").agg(F.avg("v").alias("v")).groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, v: s + v * v))
    return means.withColumn("_n", norm).select("category", F.when(F.col("_n") > 0, F.transform("m", lambda v: v / F.col("_n"))).otherwise(F.col("m")).alias("centroid"))


#: Communities whose centroids the driver gathers to consolidate them; more are an error, not a silent cut.
MOST_COMMUNITIES = 100_000
#: Average linkage holds a distance for each pair on the driver: 128 MB at this bound.
MOST_LINKED = 4_000


def farthest_first(points: np.ndarray, count: int) -> list[list[int]]:
    """Groups around seeds: each next seed is the point least similar to those before; ties by place."""
    if len(points) <= count:
        return [[i] for i in range(len(points))]
    seeds, nearest = [0], points @ points[0]
    free = np.ones(len(points), dtype=bool)
    free[0] = False
    while len(seeds) < count:
        seed = int(np.flatnonzero(free)[np.argmin(nearest[free])])
        seeds.append(seed)
        free[seed] = False
        nearest = np.maximum(nearest, points @ points[seed])
    ordered = sorted(seeds)
    groups = {s: [s] for s in seeds}
    for i in np.flatnonzero(free):
        groups[ordered[int(np.argmax(points[ordered] @ points[i]))]].append(int(i))
    return [sorted(groups[s]) for s in seeds]


def average_linkage(points: np.ndarray, count: int) -> list[list[int]]:
    """Agglomerative groups by mean Euclidean distance; the closest two merge until `count` are left, ties by place.

    One matrix of distances is held; each row remembers its nearest, so a merge looks at few rows again.
    """
    if len(points) > MOST_LINKED:
        raise ValueError(f"{len(points)} communities; average linkage takes at most {MOST_LINKED}")
    n = len(points)
    squares = (points * points).sum(axis=1)
    apart = points @ points.T
    apart *= -2.0
    apart += squares[:, None]
    apart += squares
    np.sqrt(np.maximum(apart, 0, out=apart), out=apart)
    np.fill_diagonal(apart, math.inf)
    groups, sizes = [[i] for i in range(n)], np.ones(n)
    nearest = apart.argmin(axis=1) if n else np.empty(0, np.int64)
    reach = apart[np.arange(n), nearest]
    for _ in range(n - count):
        i = int(np.argmin(reach))
        a, b = sorted((i, int(nearest[i])))
        merged = (apart[a] * sizes[a] + apart[b] * sizes[b]) / (sizes[a] + sizes[b])
        merged[[a, b]] = math.inf
        apart[a], apart[:, a] = merged, merged
        apart[b], apart[:, b] = math.inf, math.inf
        sizes[a] += sizes[b]
        groups[a], groups[b] = groups[a] + groups[b], []
        stale = np.isin(nearest, (a, b))
        stale[a] = True
        closer = ~stale & ((merged < reach) | ((merged == reach) & (a < nearest)))
        nearest[closer], reach[closer] = a, merged[closer]
        rows = np.flatnonzero(stale)
        nearest[rows] = apart[rows].argmin(axis=1)
        reach[rows] = apart[rows, nearest[rows]]
    return [sorted(g) for g in groups if g]


def consolidate(vectors: DataFrame, membership: DataFrame, most: int, method: str = "farthest_first") -> DataFrame:
    """key, category, source_communities: at most `most` categories, renumbered by smallest member."""
    first = membership.groupBy("category").agg(F.min("key").alias("first"))
    n = first.count()
    if n <= most:
        return membership.withColumn("source_communities", F.lit(1).cast("long"))
    if n > MOST_COMMUNITIES:
        raise ValueError(f"{n} communities; at most {MOST_COMMUNITIES} can be consolidated")
    rows = centroids(vectors, membership).join(first, "category").orderBy("first", "category").collect()
    points = np.array([r["centroid"] for r in rows])
    groups = sorted({"farthest_first": farthest_first, "average": average_linkage}[method](points, most), key=lambda g: min(rows[i]["first"] for i in g))
    mapping = [(rows[i]["category"], f"category-{k:04d}", len(g)) for k, g in enumerate(groups, 1) for i in g]
    table = membership.sparkSession.createDataFrame(mapping, "category string, merged string, source_communities long")
    return membership.join(table, "category").select("key", F.col("merged").alias("category"), "source_communities")
