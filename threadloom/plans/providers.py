"""Providers of embeddings and analyses: protocols, the local ones, and a router per stage."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import vectors
from threadloom.operators import cost, profiles, taxonomy
from threadloom.plans.session import settled


class EmbeddingProvider(Protocol):
    name: str
    model: str

    def embed(self, items: DataFrame) -> DataFrame:
        """key, vector for every conversation_key of the items."""


class AnalysisProvider(Protocol):
    name: str
    model: str
    # A provider whose profile of an item depends on other items has `contextual` set, and isn't cached.

    def analyze(self, items: DataFrame) -> DataFrame:
        """One profile per item, by conversation_key."""

    def interpret(self, drafts: DataFrame) -> DataFrame:
        """category, name, parent_name, concepts, confidence for every draft."""


@dataclass
class LocalEmbeddings:
    dimensions: int = vectors.DIMENSIONS
    name: str = "local"

    def __post_init__(self) -> None:
        if self.dimensions < 64:
            raise ValueError("at least 64 dimensions")
        self.model = f"signed-feature-hashing-v2-{self.dimensions}d"

    def embed(self, items: DataFrame) -> DataFrame:
        return vectors.hash_embeddings(items, "conversation_key", F.col("title"), F.col("text"), self.dimensions)


@dataclass
class LocalAnalyses:
    batch_size: int | None = 8
    name: str = "local"
    contextual: bool = True
    model: str = "transparent-semantic-heuristics-v2"

    def analyze(self, items: DataFrame) -> DataFrame:
        return profiles.profiles(items, self.batch_size)

    def interpret(self, drafts: DataFrame) -> DataFrame:
        return taxonomy.interpret(drafts)


@dataclass
class Routed:
    """One provider for each stage."""

    baseline: AnalysisProvider
    refined: AnalysisProvider
    naming: AnalysisProvider
    name: str = "routed"

    @property
    def model(self) -> str:
        return f"{self.baseline.model}+{self.refined.model}+{self.naming.model}"

    @property
    def contextual(self) -> bool:
        return getattr(self.baseline, "contextual", False)

    def analyze(self, items: DataFrame) -> DataFrame:
        return self.baseline.analyze(items)

    def interpret(self, drafts: DataFrame) -> DataFrame:
        return self.naming.interpret(drafts)


def covered(wanted: DataFrame, key: str, got: DataFrame, got_key: str) -> None:
    """A provider must answer for every key, once, and for no other."""
    if not wanted.select(key).exceptAll(got.select(F.col(got_key).alias(key))).isEmpty() or not got.select(F.col(got_key).alias(key)).exceptAll(wanted.select(key)).isEmpty():
        raise ValueError("a provider's answer doesn't cover the keys it was asked for")


def _cached(items: DataFrame, provider: EmbeddingProvider | AnalysisProvider, folder: str, key: str, produce) -> DataFrame:
    """What `produce` gives for the items, by (provider, model, text digest, title): rows in the folder aren't made again.

    New rows are appended as Parquet files in one commit; a write that doesn't end leaves its files in a temporary folder.
    """
    wanted = items.withColumn("key", F.col("conversation_key")).withColumn("cache_key", cost.cache_key(F.lit(provider.name), F.lit(provider.model), F.col("text_sha256"), F.sha2("title", 256)))
    try:
        cache = items.sparkSession.read.parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = None
    if cache is None:
        hits, lacking, n = None, wanted, 0
    else:
        hits = settled(cost.cached(wanted, cache).drop("cache_key", "seq"))
        lacking, n = cost.missing(wanted, cache), cache.count()
    fresh = settled(produce(lacking.drop("key", "cache_key")))
    covered(lacking, "key", fresh, key)
    keyed = fresh if key == "key" else fresh.withColumn("key", F.col(key))
    if hits is None or not fresh.isEmpty():
        keyed.join(wanted.select("key", "cache_key"), "key").withColumn("seq", F.lit(n).cast("long")).write.mode("append").option("compression", "zstd").parquet(folder)
    return fresh if hits is None else hits.select(*fresh.columns).unionByName(fresh)


def cached_embeddings(items: DataFrame, provider: EmbeddingProvider, folder: str | None) -> DataFrame:
    """Embeddings: what the folder has isn't computed again; new ones are appended."""
    if folder:
        return _cached(items, provider, folder, "key", provider.embed)
    out = settled(provider.embed(items))
    covered(items, "conversation_key", out, "key")
    return out


def cached_profiles(items: DataFrame, provider: AnalysisProvider, folder: str | None) -> DataFrame:
    """Profiles in the same way, for providers that judge each item by itself.

    The local one doesn't: which handles recur depends on an item's neighbours and position, so it is asked for all items.
    """
    if folder and not getattr(provider, "contextual", False):
        out = _cached(items, provider, folder, "conversation_key", provider.analyze)
        # Places move when an archive grows: they are those of the items, not those of the cache.
        return out.drop("position").join(items.select("conversation_key", "position"), "conversation_key").select(*out.columns)
    out = settled(provider.analyze(items))
    covered(items, "conversation_key", out, "conversation_key")
    return out
