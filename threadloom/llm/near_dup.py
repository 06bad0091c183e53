"""MinHash near-dedup with sequential Bayesian verification.

A document's set holds its distinct shingles of `size` words; documents whose sets have a Jaccard similarity of at least
`threshold` percent are linked, and each connected group keeps its smallest doc_id.

1. One pass over the texts: set size, a 128-bit fingerprint of the set, a signature of HASHES minima.
2. Equal sets collapse to a class: a group of copies, however large, is one row from here on. What stands for a class is
   its smallest doc_id with a hash of that row's text, so rows that repeat a doc_id are judged each by its own text.
3. Banding: classes that agree in a band meet. Each meets its bucket's smallest member first, which makes as many
   candidates as members, not their square.
4. Candidates' signatures are compared batch by batch; a pair goes as soon as the posterior probability (uniform prior)
   that its similarity reaches the threshold falls below MISS. Only the survivors' texts are read again, and survivors
   are verified exactly on full sets: first the best candidate of each class, then only pairs that aren't yet connected.
5. Buckets whose members aren't all connected by then compare, in blocks of bounded size, the members outside the
   largest connected part with all others: first signatures alone, which leaves the members with a survivor; only their
   texts are read, and their survivors are verified exactly in blocks that pass on only the links that connect their
   parts. So every pair that shares a band is either connected, pruned by its posterior, or exactly verified: no bucket
   has a cap.

Bands have as many rows as let a pair at the threshold share none with a probability under UNMET; at 85 percent that is
(1 - 0.85 ** 5) ** 24 = 8e-7, at 80 percent (1 - 0.8 ** 4) ** 30 = 1e-7.

Skew. Joins by bucket, by a bucket's smallest member and by fingerprint are salted by counted sizes. Signatures and sets
never go to the driver; components come from min-label propagation with pointer jumping, in as many tasks as its links
ask for. Intermediate tables are written and read again, so what Spark broadcasts is small by its files' size.

Defined results. Without words or text: an empty set, linked with nothing. Rows without a doc_id are linked with
nothing and kept. Repeated rows are one class, whose smallest doc_id is kept in each of its rows. Very long texts are
taken whole; sets are built in memory, one text at a time. Other columns, whatever their names, are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import rest, salted_join, salts, stored

SHINGLE = 3
THRESHOLD = 85
HASHES = 120
BATCH = 24
MISS = 1e-7
UNMET = 1e-6
#: Members of a bucket, on either side, that one task compares at a time.
OUTER_BLOCK, INNER_BLOCK = 256, 1024
#: Links, or labels of their ends, that one task takes in the search for components.
LINKS_A_TASK = 200_000
#: Bits of the filter that tells which texts are read again; a fuller filter only lets more of them pass.
FILTER_BUCKETS = 1024
_REMEMBERED = 250_000

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_C = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, or of its UTF-8 bytes."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    # For bytes, lower() changes A-Z alone and split() splits at U+0020 and U+0009 to U+000D alone.
    words = raw.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_WORDS) > _REMEMBERED:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) < size:
        short = np.append(h, np.uint64(len(h)))
        return _mixed((short * _C[: len(short)][::-1]).sum(keepdims=True))
    n = len(h) - size + 1
    total = h[:n] * _C[0]
    for i in range(1, size):
        total += h[i : i + n] * _C[i]
    total = np.sort(_mixed(total))
    return total[np.r_[True, total[1:] != total[:-1]]]


def signature(members: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over the set."""
    low = np.full(HASHES, np.iinfo(np.uint32).max, dtype=np.uint32)
    folded = (members >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(folded), 2048):
        part = folded[None, at : at + 2048] * _A[:, None]
        part += _B[:, None]
        low = np.minimum(low, part.min(axis=1))
    return low


@dataclass(frozen=True)
class Scheme:
    """What counts as a near copy: words in a shingle, and the least similarity in percent."""

    size: int = SHINGLE
    threshold: int = THRESHOLD

    @cached_property
    def rows(self) -> int:
        """Hashes in a band: as many as leave a pair at the threshold unmet with a probability under UNMET."""
        t = self.threshold / 100
        return max((r for r in range(1, HASHES + 1) if HASHES % r == 0 and (1 - t**r) ** (HASHES // r) < UNMET), default=1)

    @property
    def bands(self) -> int:
        return HASHES // self.rows

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Exactly: 100 * intersection >= threshold * union."""
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.threshold * (len(a) + len(b) - both)

    @cached_property
    def least_matches(self) -> list[tuple[int, int]]:
        """(hashes compared, matches needed): with fewer, P(similarity >= threshold) is under MISS.

        With a uniform prior, the posterior after m matches of n is Beta(m + 1, n - m + 1); its tail beyond t equals
        P(Binomial(n + 1, t) <= m).
        """
        t, out = self.threshold / 100, []
        for n in range(BATCH, HASHES + 1, BATCH):
            tail, m = 0.0, 0
            while (tail := tail + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < MISS:
                m += 1
            out.append((n, m))
        return out

    def survivors(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of signature pairs that no batch prunes, and their numbers of matches."""
        alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
        for n, needed in self.least_matches:
            matches = matches + (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(axis=1)
            keep = matches >= needed
            alive, matches = alive[keep], matches[keep]
        return alive, matches

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """Rows of band keys for rows of signatures."""
        rows = signatures.astype(np.uint64).reshape(-1, self.bands, self.rows)
        total = np.arange(self.bands, dtype=np.uint64)[None, :] * _C[-1]
        for i in range(self.rows):
            total = _mixed(total + rows[:, :, i] * _C[i])
        return total.view(np.int64)

    def features(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, signatures = [], [], []
            for text in batch.column(2).to_pylist():
                members = shingle_set(text, self.size)
                sizes.append(len(members))
                prints.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest())
                signatures.append(signature(members).tobytes() if len(members) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "hash", "n", "print", "signature"])
        _WORDS.clear()
        rest()

    def keys(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = self.band_keys(_stacked(batch.column(1))).reshape(-1)
                classes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), self.bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(classes)], ["key", "class"])

    def pruned(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive, matches = self.survivors(_stacked(batch.column(2)), _stacked(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive)), pa.array(matches)], ["a", "b", "matches"])

    def verified(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py()
                if a != last[0]:
                    last = (a, shingle_set(zlib.decompress(batch.column(2)[i].as_py()), self.size))
                if self.similar(last[1], shingle_set(zlib.decompress(batch.column(3)[i].as_py()), self.size)):
                    kept.append(i)
            chosen = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen)], ["a", "b"])
        _WORDS.clear()
        rest()


def _stacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


def _packed(text: str) -> bytes:
    return zlib.compress(text.encode("utf-8", "surrogatepass"), 1)


def _dense(df: DataFrame, n: int) -> DataFrame:
    """In no more tasks than n rows ask for."""
    return df.coalesce(max(1, -(-n // LINKS_A_TASK)))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches) for every end of the edges a, b."""
    edges = stored(edges.select("a", "b"))
    n = 2 * edges.count()
    ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(_dense(ways.distinct(), n))
    labels = stored(_dense(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")), n))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("_a")).agg(F.min("component").alias("_near"))
        told = labels.join(near, F.col("node") == F.col("_a")).select("node", F.least("component", "_near").alias("low"), F.col("component").alias("old"))
        told = stored(_dense(told, n))
        roots = told.select(F.col("node").alias("_root"), F.col("low").alias("_low"))
        jumped = stored(_dense(told.join(roots, F.col("low") == F.col("_root")).select("node", F.least("low", "_low").alias("component"), "old"), n))
        labels = jumped.select("node", "component")
        if not jumped.where("component <> old").limit(1).count():
            return labels


def _lifted(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs with ca and cb, the components of their ends, where these differ."""
    a = labels.select(F.col("node").alias("a"), F.col("component").alias("_ca"))
    b = labels.select(F.col("node").alias("b"), F.col("component").alias("_cb"))
    met = pairs.join(a, "a", "left").join(b, "b", "left")
    return met.withColumn("ca", F.coalesce("_ca", "a")).withColumn("cb", F.coalesce("_cb", "b")).where("ca <> cb").drop("_ca", "_cb")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after some more links: only the components that these connect are searched again."""
    moved = components(_lifted(links, labels).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    moved = moved.select(F.col("node").alias("_old"), F.col("component").alias("_new"))
    fresh = moved.join(labels, F.col("_old") == F.col("node"), "left_anti").select(F.col("_old").alias("node"), F.col("_old").alias("component"))
    every = labels.unionByName(fresh)
    return stored(every.join(moved, F.col("component") == F.col("_old"), "left").select("node", F.coalesce("_new", "component").alias("component")))


class _Corpus:
    """The texts behind the classes, and what is known about pairs of them."""

    def __init__(self, docs: DataFrame, scheme: Scheme):
        self.scheme = scheme
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("hash"), F.col("text").cast("string").alias("text"))
        self.rows = stored(self.texts.mapInArrow(scheme.features, "doc_id long, hash long, n long, print binary, signature binary"))
        real = self.rows.where("n > 0 and doc_id is not null")
        classes = real.groupBy("print").agg(F.min(F.struct("doc_id", "hash")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"))
        self.classes = stored(classes.select("print", "first.doc_id", "first.hash", "copies", "signature", F.monotonically_increasing_id().alias("class")))
        self.signatures = self.classes.select("class", "signature")

    def _met(self, pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
        """pairs with _a and _b, the values of their ends; the pairs of a class that many of them start from are split."""
        pieces = salts(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), ["a"], "n", pairs.count())
        left = values.select(F.col("class").alias("a"), F.col(value).alias("_a"))
        right = values.select(F.col("class").alias("b"), F.col(value).alias("_b"))
        return salted_join(pairs, left, ["a"], pieces, ["b"]).join(right, "b").select("a", "b", "_a", "_b")

    def prune(self, pairs: DataFrame) -> DataFrame:
        """a, b, matches of the pairs a, b whose signatures leave them possible."""
        return stored(self._met(stored(pairs), self.signatures, "signature").mapInArrow(self.scheme.pruned, "a long, b long, matches long"))

    def read_again(self, wanted: DataFrame) -> DataFrame:
        """class, packed: the texts of the classes. A bit filter of fixed size lets few others pass."""
        ends = stored(wanted.distinct().join(self.classes.select("class", "doc_id", "hash"), "class"))
        bits = 8 * 4096 * FILTER_BUCKETS

        def place(seed: int) -> Column:
            return F.pmod(F.xxhash64(F.lit(seed), "doc_id", "hash"), F.lit(bits)) + 1

        spots = ends.select(F.explode(F.array(place(1), place(2))).alias("p"))
        maps = spots.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
        whole = np.zeros(FILTER_BUCKETS * 4096, dtype=np.uint8)
        for row in maps:
            at = (row["bucket"] - 1) * 4096
            whole[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
        shared = self.rows.sparkSession.sparkContext.broadcast(whole)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for batch in batches:
                hit = np.ones(batch.num_rows, dtype=bool)
                for k in (3, 4):
                    p = batch.column(k).to_numpy(zero_copy_only=False) - 1
                    hit &= (table[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
                part = batch.filter(pa.array(hit))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([_packed(t or "") for t in part.column(2).to_pylist()], pa.binary())], ["doc_id", "hash", "packed"])

        found = self.texts.where("doc_id is not null").select("doc_id", "hash", "text", place(1).alias("p1"), place(2).alias("p2")).mapInArrow(run, "doc_id long, hash long, packed binary")
        return stored(found.join(ends, ["doc_id", "hash"]).groupBy("class").agg(F.first("packed").alias("packed")))

    def verify(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs a, b whose full sets are similar."""
        return stored(self._met(stored(pairs.select("a", "b")), texts, "packed").mapInArrow(self.scheme.verified, "a long, b long"))


class _Block:
    """Outer rows against inner rows of one bucket."""

    def __init__(self, table: pa.Table, scheme: Scheme):
        get = lambda c: table.column(c).to_numpy()
        self.scheme, self.key = scheme, table.column("key")[0].as_py()
        self.side, self.ids, self.component, self.outside = get("side"), get("class"), get("component"), get("outside")
        self.signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
        self.packed, self.sets = table.column("packed") if "packed" in table.column_names else None, {}
        self.band = int(np.flatnonzero(scheme.band_keys(self.signatures[:1])[0] == self.key)[0])
        self.inner = np.flatnonzero(self.side == 1)

    def possible(self, i: int, root: np.ndarray) -> np.ndarray:
        """The inner rows outside an outer row's part that its signature leaves possible."""
        # Two outer rows meet twice; one of the meetings is enough.
        others = self.inner[(root[self.inner] != root[i]) & (~self.outside[self.inner] | (self.ids[self.inner] > self.ids[i]))]
        # A pair that shares several bands belongs to the first of them.
        agree = (self.signatures[others] == self.signatures[i]).reshape(-1, self.scheme.bands, self.scheme.rows).all(axis=2)
        others = others[agree[:, self.band] & (agree.argmax(axis=1) == self.band)]
        alive, _ = self.scheme.survivors(np.broadcast_to(self.signatures[i], (len(others), HASHES)), self.signatures[others])
        return others[alive]

    def members(self, row: int) -> np.ndarray:
        if row not in self.sets:
            self.sets[row] = shingle_set(zlib.decompress(self.packed[row].as_py()), self.scheme.size)
        return self.sets[row]

    def similar_to(self, row: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` whose full sets are similar to the row's, by one search over all of them."""
        own, sets = self.members(row), [self.members(int(j)) for j in others]
        sizes = np.array([len(x) for x in sets])
        every = np.concatenate(sets)
        at = np.minimum(np.searchsorted(own, every), len(own) - 1)
        both = np.add.reduceat((own[at] == every).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
        return others[100 * both >= self.scheme.threshold * (len(own) + sizes - both)]

    def with_survivors(self) -> list[int]:
        """The classes that have a possible partner in another part."""
        found = np.zeros(len(self.ids), dtype=bool)
        for i in np.flatnonzero(self.side == 0):
            others = self.possible(i, self.component)
            found[others] = True
            found[i] |= len(others) > 0
        return np.unique(self.ids[found]).tolist()

    def links(self) -> list[tuple[int, int]]:
        """Links that connect parts, no more than that takes."""
        root, found = self.component.copy(), []
        for i in np.flatnonzero(self.side == 0):
            others = self.possible(i, root)
            for j in self.similar_to(i, others) if len(others) else ():
                if root[j] != root[i]:
                    found.append((min(int(self.ids[i]), int(self.ids[j])), max(int(self.ids[i]), int(self.ids[j]))))
                    root[root == root[j]] = root[i]
        return found


def _blocks(members: DataFrame, carried: DataFrame, scheme: Scheme) -> DataFrame:
    """From members (key, class, component) and carried (class, signature, perhaps packed): what their blocks find.

    Without texts: key, class of the members with a possible partner in another component. With texts: a, b, verified
    links between components. Members outside a bucket's largest component (the outer ones) meet all others, in blocks.
    """
    exact = "packed" in carried.columns
    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"))
    main = stored(main.select("key", F.col("main.component").alias("main"), "all", (F.col("all") - F.col("main.n")).alias("outer")).where("outer > 0"))
    met = salted_join(members, main, ["key"], salts(main, ["key"], "all", members.count()), ["class"]).withColumn("outside", F.col("component") != F.col("main"))
    spread = F.xxhash64("class")
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    own = F.pmod(spread, blocks("outer", OUTER_BLOCK)).cast("int")
    inner = F.pmod(spread, blocks("all", INNER_BLOCK)).cast("int")
    outer = met.where("outside").withColumn("x", own).withColumn("y", F.explode(F.sequence(F.lit(0), blocks("all", INNER_BLOCK) - 1))).withColumn("side", F.lit(0))
    every = met.withColumn("y", inner).withColumn("x", F.explode(F.sequence(F.lit(0), blocks("outer", OUTER_BLOCK) - 1))).withColumn("side", F.lit(1))
    columns = ["key", "x", "y", "side", "class", "component", "outside"]
    dealt = outer.select(*columns).unionByName(every.select(*columns)).join(carried, "class")

    def compare(table: pa.Table) -> pa.Table:
        block = _Block(table, scheme)
        if exact:
            found = block.links()
            return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})
        found = block.with_survivors()
        return pa.table({"key": pa.array([block.key] * len(found), pa.int64()), "class": pa.array(found, pa.int64())})

    return dealt.groupBy("key", "x", "y").applyInArrow(compare, "a long, b long" if exact else "key long, class long").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    scheme = Scheme(size, threshold)
    corpus = _Corpus(docs, scheme)
    n_classes = corpus.classes.count()
    banded = corpus.signatures.mapInArrow(scheme.keys, "key long, class long")
    shared = stored(banded.groupBy("key").agg(F.min("class").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    pieces = salts(shared, ["key"], "n", n_classes * scheme.bands)
    members = stored(salted_join(banded, shared, ["key"], pieces, ["class"]).select("key", "class", "low"))
    pairs = corpus.prune(members.where("class <> low").select(F.col("low").alias("a"), F.col("class").alias("b")).distinct())
    texts = corpus.read_again(pairs.select(F.explode(F.array("a", "b")).alias("class")))

    best = pairs.groupBy("b").agg(F.max(F.struct("matches", F.negative("a").alias("a"))).alias("best")).select(F.negative(F.col("best.a")).alias("a"), "b")
    labels = components(corpus.verify(best, texts))
    further = _lifted(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), labels)
    labels = merged(labels, corpus.verify(further, texts))

    # What is left: members of one bucket that are still apart.
    known = members.join(labels.withColumnRenamed("node", "class"), "class", "left").select("key", "class", F.coalesce("component", "class").alias("component"))
    known = stored(known)
    split = stored(known.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count(F.lit(1)).alias("n")).where("_low <> _high").select("key", "n"))
    left = stored(salted_join(known, split.select("key"), ["key"], salts(split, ["key"], "n", known.count()), ["class"]))
    likely = stored(_blocks(left, corpus.signatures, scheme))
    if likely.limit(1).count():
        chosen = stored(left.join(likely, ["key", "class"]))
        read = corpus.read_again(likely.select("class"))
        labels = merged(labels, _blocks(chosen, corpus.signatures.join(read, "class"), scheme))

    # A component's name is the smallest doc_id of its classes.
    linked = labels.join(corpus.classes.select(F.col("class").alias("node"), "doc_id"), "node")
    names = linked.groupBy("component").agg(F.min("doc_id").alias("name"))
    named = labels.join(names, "component").select(F.col("node").alias("class"), "name")
    groups = corpus.classes.select("print", "class", "doc_id").join(named, "class", "left").select("print", F.coalesce("name", "doc_id").alias("name"))
    real = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = salted_join(corpus.rows.where(real).select("doc_id", F.col("n").alias("n_shingles"), "print"), groups, ["print"], salts(corpus.classes, ["print"], "copies", corpus.rows.count()), ["doc_id"])
    alone = corpus.rows.where(~real | real.isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("name"))
    out = out.select("doc_id", "n_shingles", "name").unionByName(alone)
    return out.select("doc_id", "n_shingles", F.col("name").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("name"), F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON doc_id = a
"""
