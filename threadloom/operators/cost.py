"""Exact money: prices, plans, ledgers, batches of requests, caches."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.plans.session import settled
from threadloom.sources.archive_json import write_json

MONEY = "decimal(38,18)"


def token_cost(tokens: Column, price_per_million: Decimal) -> Column:
    return (tokens.cast("decimal(18,0)") * F.lit(price_per_million).cast("decimal(12,6)") / F.lit(1_000_000).cast("decimal(7,0)")).cast(MONEY)


def plan(estimate: DataFrame, embedding_price: Decimal, input_price: Decimal, output_price: Decimal, batch: int = 8, per_reply: int = 512, reserve: float = 1.2) -> DataFrame:
    """One row: requests, tokens and costs of a run, expected and reserved (tokens rounded up with the reserve)."""
    rows = estimate.select("items", "approximate_tokens").withColumn("requests", F.ceil(F.col("items") / batch).cast("long"))
    rows = rows.withColumn("output_tokens", F.col("items") * per_reply)
    rows = rows.withColumn("reserved_tokens", F.ceil(F.col("approximate_tokens") * F.lit(reserve)).cast("long") + per_reply * F.col("requests"))
    embedding, read, write = token_cost(F.col("approximate_tokens"), embedding_price), token_cost(F.col("approximate_tokens"), input_price), token_cost(F.col("output_tokens"), output_price)
    return rows.select("*", embedding.alias("embedding_cost"), (embedding + read + write).cast(MONEY).alias("expected_cost"), (embedding + token_cost(F.col("reserved_tokens"), input_price) + write).cast(MONEY).alias("reserved_cost"))


@dataclass(frozen=True)
class Price:
    """Money per million tokens read and written."""

    read: Decimal
    write: Decimal = Decimal(0)

    def of(self, read: Column, written: Column | None = None) -> Column:
        return token_cost(read, self.read) if written is None else (token_cost(read, self.read) + token_cost(written, self.write)).cast(MONEY)


@dataclass(frozen=True)
class Work:
    """Bounds of a hierarchical run."""

    leaf_categories: int
    refined_per_category: int
    most_refined: int
    batch: int
    embedding_tokens: int
    profile_tokens: int
    profile_reply: int
    taxonomy_reply: int
    synthesis_reply: int

    def __post_init__(self):
        if self.most_refined < 0 or min(v for k, v in vars(self).items() if k != "most_refined") <= 0:
            raise ValueError("limits must be positive; only the number of refined conversations may be 0")


#: Tokens that a stage reads or writes at all, for each category, and for each refined conversation.
TAXONOMY_READ, SYNTHESIS_READ = (2_000, 700, 160), (3_000, 1_100, 220)
PROFILE_WRITE, TAXONOMY_WRITE, SYNTHESIS_WRITE = 180, 150, 8_000
RESERVE, REQUEST_RESERVE = Decimal("1.2"), 512


def scheduled_plan(estimate: DataFrame, embedding: Price, profile: Price, taxonomy: Price, synthesis: Price, work: Work, ceiling: Decimal) -> DataFrame:
    """One row: the counts, tokens and costs of a run with bounded refinement, and whether its reserve fits the ceiling.

    estimate: items, approximate_tokens. The reserve prices a fifth more input, 512 tokens a request, and replies of full length.
    """
    if ceiling <= 0:
        raise ValueError("the ceiling must be positive")
    whole = lambda c: c.cast("long")
    more = lambda c: whole(F.ceil(c.cast("decimal(18,0)") * F.lit(RESERVE).cast("decimal(3,1)")))
    read = lambda fixed: F.lit(fixed[0] + work.leaf_categories * fixed[1]) + F.col("refined_count") * fixed[2]
    written = F.lit(work.leaf_categories * TAXONOMY_WRITE).cast("long")
    rows = estimate.select("items", "approximate_tokens")
    rows = rows.withColumn("refined_count", whole(F.least("items", F.lit(work.most_refined), F.lit(work.leaf_categories * work.refined_per_category))))
    rows = rows.withColumn("profile_requests", whole(F.ceil(F.col("refined_count") / work.batch)))
    rows = rows.withColumn("embedding_tokens", whole(F.least("approximate_tokens", F.col("items") * work.embedding_tokens)))
    average = F.coalesce(whole(F.ceil(F.try_divide("approximate_tokens", "items"))), F.lit(0))
    rows = rows.withColumns({"_profile": whole(F.col("refined_count") * F.least(average, F.lit(work.profile_tokens))), "_taxonomy": whole(read(TAXONOMY_READ)), "_synthesis": whole(read(SYNTHESIS_READ)), "_replies": whole(F.col("refined_count") * PROFILE_WRITE)})
    expected = embedding.of(F.col("embedding_tokens")) + profile.of(F.col("_profile"), F.col("_replies")) + taxonomy.of(F.col("_taxonomy"), written) + synthesis.of(F.col("_synthesis"), F.lit(SYNTHESIS_WRITE))
    full = profile.of(more(F.col("_profile")) + F.col("profile_requests") * REQUEST_RESERVE, F.col("profile_requests") * work.profile_reply)
    reserve = embedding.of(more(F.col("embedding_tokens"))) + full + taxonomy.of(more(F.col("_taxonomy")) + REQUEST_RESERVE, F.lit(work.taxonomy_reply)) + synthesis.of(more(F.col("_synthesis")) + REQUEST_RESERVE, F.lit(work.synthesis_reply))
    return rows.select(
        "items", "refined_count", "profile_requests", "embedding_tokens",
        (F.col("_profile") + F.col("_taxonomy") + F.col("_synthesis")).alias("structured_input_tokens"),
        (F.col("_replies") + written + SYNTHESIS_WRITE).alias("structured_output_tokens"),
        expected.cast(MONEY).alias("expected_cost"), reserve.cast(MONEY).alias("reserved_cost"),
        (reserve.cast(MONEY) <= F.lit(ceiling).cast(MONEY)).alias("fits"),
    )


def ledger_snapshot(entries: DataFrame, ceiling: Decimal) -> DataFrame:
    """One row: charged, remaining (never below 0), completed, unsettled. entries: state, reserved, settled.

    A request that isn't completed is charged what was reserved for it, also if it failed: it may have been billed.
    """
    done = F.col("state") == "completed"
    charged = F.coalesce(F.sum(F.when(done, F.col("settled")).otherwise(F.col("reserved"))), F.lit(0)).cast(MONEY)
    rows = entries.agg(charged.alias("charged"), F.count_if(done).alias("completed"), F.count_if(~done).alias("unsettled"))
    return rows.withColumn("remaining", F.greatest(F.lit(0).cast(MONEY), F.lit(ceiling).cast(MONEY) - F.col("charged")))


class Ledger:
    """Reservations before a request, settlement after it; the ceiling can only grow, and only when asked.

    With a path, each change is on disk, whole, before the method returns; a ledger found there goes on, if its ceiling is
    the same or may grow.
    """

    def __init__(self, ceiling: Decimal, path: str | Path | None = None, allow_increase: bool = False):
        if ceiling <= 0:
            raise ValueError("the ceiling must be positive")
        self.ceiling, self.entries, self.path = ceiling, {}, Path(path) if path else None
        if self.path is not None and self.path.is_file():
            try:
                found = json.loads(self.path.read_text(encoding="utf-8"))
                self.ceiling = Decimal(found["ceiling"])
                self.entries = {n: {"state": e["state"], "reserved": Decimal(e["reserved"]), "settled": Decimal(e["settled"])} for n, e in found["entries"].items()}
            except (AttributeError, KeyError, TypeError, ValueError, ArithmeticError) as e:
                raise ValueError("the ledger on disk can't be read") from e
            if self.ceiling != ceiling:
                self.raise_ceiling(ceiling, allow_increase)
        else:
            self._keep()

    def _keep(self) -> None:
        if self.path is not None:
            write_json(self.path, {"ceiling": self.ceiling, "entries": self.entries})

    @property
    def charged(self) -> Decimal:
        return sum((e["settled"] if e["state"] == "completed" else e["reserved"] for e in self.entries.values()), Decimal(0))

    def reserve(self, name: str, amount: Decimal) -> None:
        if name in self.entries or amount < 0:
            raise ValueError("a reservation needs a new name and an amount")
        if self.charged + amount > self.ceiling:
            raise ValueError("the reservation exceeds the ceiling")
        self.entries[name] = {"state": "reserved", "reserved": amount, "settled": Decimal(0)}
        self._keep()

    def settle(self, name: str, amount: Decimal | None) -> None:
        """Charges what was used, or the reservation where that isn't known. Beyond the ceiling all stops."""
        entry = self.entries.get(name, {})
        if entry.get("state") != "reserved" or (amount is not None and amount < 0):
            raise ValueError("only a reservation can be settled, by an amount that isn't negative")
        self.entries[name] = entry | {"state": "completed", "settled": entry["reserved"] if amount is None else amount}
        self._keep()
        if self.charged > self.ceiling:
            raise ValueError("more was used than the ceiling allows")

    def fail(self, name: str) -> None:
        """The reservation stays charged; a request that has ended stays as it is."""
        if self.entries[name]["state"] == "reserved":
            self.entries[name] = self.entries[name] | {"state": "failed"}
            self._keep()

    def raise_ceiling(self, ceiling: Decimal, allowed: bool = False) -> None:
        if not allowed or ceiling < self.ceiling:
            raise ValueError("the ceiling only grows, on request")
        self.ceiling = ceiling
        self._keep()

    def table(self, spark) -> DataFrame:
        rows = [(n, e["state"], e["reserved"], e["settled"]) for n, e in self.entries.items()]
        return spark.createDataFrame(rows, f"name string, state string, reserved {MONEY}, settled {MONEY}")


class _Range:
    """One range of items in order, and where a batch ends that begins at any of them."""

    def __init__(self, batches: list[pa.RecordBatch], most_items: int, most_tokens: int):
        column = lambda name: np.concatenate([np.zeros(0, np.int64), *(b.column(name).to_numpy(zero_copy_only=False) for b in batches)]).astype(np.int64)
        self.position, self.tokens = column("position"), column("tokens")
        self.n, self.before = len(self.tokens), np.concatenate([[0], np.cumsum(self.tokens)])
        begin = np.arange(self.n)
        full = np.searchsorted(self.before, self.before[:-1] + most_tokens, side="right") - 1
        self.end = np.minimum(np.maximum(full, begin + 1), begin + most_items)

    def outcomes(self, most_items: int) -> dict[str, list]:
        """For each item that may be the range's first to begin a batch: the batches begun, and what the last one holds."""
        begun, last = np.ones(self.n, np.int64), np.arange(self.n)
        for i in range(self.n - 1, -1, -1):
            if self.end[i] < self.n:
                begun[i], last[i] = begun[self.end[i]] + 1, last[self.end[i]]
        few = min(self.n, most_items)
        return {"begun": begun[:few].tolist(), "held": (self.n - last[:few]).tolist(), "held_tokens": (self.before[-1] - self.before[last[:few]]).tolist(), "running": self.before[1 : few + 1].tolist()}

    def numbered(self, first: int, batch: int) -> np.ndarray:
        """The batch of each item: `batch` ahead of `first`, where the next one begins."""
        begins = np.zeros(self.n, np.int64)
        while first < self.n:
            begins[first], first = 1, self.end[first]
        return batch + np.cumsum(begins)


def request_batches(items: DataFrame, most_items: int, most_tokens: int) -> DataFrame:
    """position, tokens, batch: greedy batches in order, closed when an item would exceed either cap.

    Ranges of positions are folded side by side. A range doesn't know how full the open batch is when it begins, so it
    reports what follows from each of its first `most_items` items as the first to begin a batch; the driver, which gets
    that many numbers a range, links the ranges up, and a second pass numbers the items. Missing tokens count as 0; an
    item beyond the cap is a batch by itself.
    """
    slim = items.select(F.col("position").cast("long").alias("position"), F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("tokens"))
    laid = settled(slim.repartitionByRange("position").sortWithinPartitions("position").withColumn("part", F.spark_partition_id()))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if batches:
            whole = _Range(batches, most_items, most_tokens)
            row = {"part": batches[0].column("part")[0].as_py(), "n": whole.n, "total": int(whole.before[-1]), **whole.outcomes(most_items)}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("begun", "held", "held_tokens", "running"))]))

    reports = laid.mapInArrow(report, "part int, n long, total long, begun array<long>, held array<long>, held_tokens array<long>, running array<long>")
    entries, batch, held, held_tokens = {}, -1, 0, 0
    for r in sorted(reports.collect(), key=lambda r: r["part"]):
        first = 0 if batch < 0 else min(most_items - held, bisect_right(r["running"], most_tokens - held_tokens))
        entries[r["part"]] = (first, batch)
        if first < r["n"]:
            batch, held, held_tokens = batch + r["begun"][first], r["held"][first], r["held_tokens"][first]
        else:
            held, held_tokens = held + r["n"], held_tokens + r["total"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if batches:
            whole = _Range(batches, most_items, most_tokens)
            numbers = whole.numbered(*entries[batches[0].column("part")[0].as_py()])
            yield pa.RecordBatch.from_arrays([pa.array(whole.position), pa.array(whole.tokens), pa.array(numbers, pa.int32())], ["position", "tokens", "batch"])

    return laid.mapInArrow(number, "position long, tokens long, batch int")


def token_window(requests: DataFrame, allowance: int, seconds: int = 60) -> DataFrame:
    """Each request with `used`, what its client asked for in the last `seconds` up to it, and whether that fits.

    requests: client, at (timestamp), tokens. Requests of one moment count together; one that is exactly `seconds` old
    counts no longer. fits is false where a request must wait, or exceeds the allowance by itself.
    """
    at = F.unix_micros("at")
    window = Window.partitionBy("client").orderBy(at).rangeBetween(1 - seconds * 1_000_000, 0)
    return requests.withColumn("used", F.sum("tokens").over(window)).withColumn("fits", F.col("used") <= allowance)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def cached(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of the cache that are wanted, the last one of each key. Both: key, cache_key; cache: seq."""
    last = F.row_number().over(Window.partitionBy("key", "cache_key").orderBy(F.desc("seq")))
    hits = cache.join(wanted.select("key", "cache_key"), ["key", "cache_key"], "left_semi")
    return hits.withColumn("_r", last).where("_r = 1").drop("_r")


def missing(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    return wanted.join(cache.select("key", "cache_key"), ["key", "cache_key"], "left_anti")
