"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source is an endless stream: its documents in a shuffled order, again and again, cut into blocks of equally many
words. A source gets as many slots of the mix as its target has blocks, so its weight is that number. Slot k takes the
k-th point of van der Corput's sequence in base 2, the reversed bits of k, through the cumulative weights to a source.
Among 2**p slots the points are all numbers below 2**p, so each source owns exactly its slots, whatever their number; it
finds them by reversing the bits of its own range, with no join. A slot's rank among its source's slots says which block
of the stream it takes, and the last block ends at the target: each source gives its target to the word.

A slot may hold a short stream several times over: its whole rounds count for all documents of the source, and what
remains meets the documents by source and block. Slots number at most twice the blocks of all words, plus the sources.

Skew. Streams are laid out by prefix sums in two levels (hash buckets within a source), ranks in two levels (chunks of
slots), sources by prefix sums over ranges, and slots meet documents by source and block: a source with a third of all
rows is spread over all of these.

Defined results. A null text has 0 words; documents without words are never taken. Null sources form one source, the
last. Repeated rows are documents of their own. Rows without a doc_id are shuffled by their text. Very long texts lie in
many blocks. If no document has words, all targets are 0. Other columns, whatever their names, are ignored. An empty
table gives an empty result. Reruns agree: the shuffle is a hash of doc_id, ties go by doc_id and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import WORD_RE, cut
from threadloom.operators.order import running

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
#: Words in a block.
BLOCK = 1024
#: Slots in a chunk, and documents in a bucket on average, that one task ranks; slots of a row before they are spread.
CHUNK = 1 << 15
BUCKET = 20_000
RUN = 1 << 12
#: Sources up to which their table (under 100 bytes a row) is broadcast; beyond, it is joined by source.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, s (its rank), source_size, weight, target: shares by weight of all words, none above epochs * its size.

    The shares are level * weight, cut at the caps; the level follows from the sources in the order in which a rising
    level reaches their caps.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running(totals, [F.col("source").asc_nulls_last()], cut).withColumnRenamed("place", "s")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", turn.cast("double")).withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    ranked = ranked.withColumn("full_at", F.col("cap") / F.col("weight"))
    ranked = cut(running(ranked, ["full_at", "s"], cut, ("cap", "weight")))
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    # The first source, in that order, whose cap lies above the level that is left for it and those after it.
    left = (F.lit(float(total or 0)) - F.col("before_cap")) / (F.lit(weight) - F.col("before_weight"))
    level = ranked.withColumn("level", left).where("full_at >= level").agg(F.min(F.struct("full_at", "s", "level"))["level"]).first()[0]
    return ranked.select("source", "s", "source_size", "weight", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def _shared(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_SOURCES else small


def _reversed(k: Column, bits: int) -> Column:
    """The number whose `bits` binary digits are those of k, last first."""
    return F.conv(F.reverse(F.lpad(F.bin(k), bits, "0")), 2, 10).cast("long")


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, s, rank, source_size, from_word, to_word: the words of source s's endless stream that each slot takes."""
    goals = goals.select("s", "source_size", F.floor("target").alias("words")).where("words > 0").withColumn("slots", F.ceil(F.col("words") / block).cast("long"))
    owned = running(goals, ["s"], cut, ("slots",))
    n = owned.agg(F.max(F.col("before_slots") + F.col("slots"))).first()[0] or 0
    bits = max(1, (n - 1).bit_length()) if n else 1
    # Long ranges are spread before they are written out, one row a slot.
    runs = owned.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / RUN)))).repartition("s", "run")
    last = F.least((F.col("run") + 1) * RUN, "slots") - 1
    dealt = runs.withColumn("k", F.explode(F.sequence(F.col("run") * RUN, last)))
    dealt = dealt.select(_reversed(F.col("before_slots") + F.col("k"), bits).alias("slot"), "s", "source_size", "words").withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    counts = dealt.groupBy("s", "chunk").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("s", "chunk", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1 + F.col("ahead")
    ranked = dealt.join(counts, ["s", "chunk"]).withColumn("rank", rank.cast("long"))
    return ranked.select("slot", "s", "rank", "source_size", (F.col("rank") * block).alias("from_word"), F.least((F.col("rank") + 1) * block, "words").alias("to_word"))


def streams(sizes: DataFrame, goals: DataFrame, n_docs: int) -> DataFrame:
    """Each document's place in its source's shuffled stream: the columns of `sizes`, s, source_size, target, at."""
    buckets = max(1, -(-n_docs // BUCKET))
    small = _shared(goals.select(F.col("source").alias("_source"), "s", "source_size", "target"))
    placed = sizes.join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("_bucket", F.pmod(F.shiftrightunsigned("_h", 8), F.lit(buckets)))
    totals = placed.groupBy("s", "_bucket").agg(F.sum("size").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("s", "_bucket", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("s", "_bucket").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_ahead") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return placed.join(totals, ["s", "_bucket"]).withColumn("at", at).drop("_h", "_bucket", "_ahead")


def mix(docs: DataFrame, carry: dict[str, Column] | None = None, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document, and the columns `carry` computes from it."""
    carry = carry or {}
    # A hash skips nulls: the text counts only where there is no doc_id.
    mixed = F.xxhash64(F.lit(1), F.col("doc_id").cast("long"), F.when(F.col("doc_id").isNull(), F.col("text")))
    sizes = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), mixed.alias("_h"), *(c.alias(n) for n, c in carry.items())))
    goals = targets(sizes, weights, epochs)
    placed = streams(sizes, goals, sizes.count())
    # A slot's words: whole rounds through the stream, and a rest from where it starts, which may go on at the stream's start.
    length = F.col("to_word") - F.col("from_word")
    slots = cut(schedule(goals).select("s", "source_size", F.floor(length / F.col("source_size")).alias("rounds"), (F.col("from_word") % F.col("source_size")).alias("low"), (length % F.col("source_size")).alias("rest")))
    rounds = slots.groupBy("s").agg(F.sum("rounds").alias("rounds"))
    high = F.col("low") + F.col("rest")
    first = F.struct(F.col("low"), F.least(high, "source_size").alias("high"))
    second = F.struct(F.lit(0).cast("long").alias("low"), (high - F.col("source_size")).alias("high"))
    parts = slots.select("s", F.explode(F.filter(F.array(first, second), lambda p: p["high"] > p["low"])).alias("p")).select("s", "p.low", "p.high")
    parts = parts.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor((F.col("high") - 1) / BLOCK))))
    parts = parts.groupBy("s", "block", F.greatest("low", F.col("block") * BLOCK).alias("low"), F.least("high", (F.col("block") + 1) * BLOCK).alias("high")).agg(F.count(F.lit(1)).alias("times"))
    first_block, last_block = F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("size") - 1) / BLOCK)
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first_block, last_block)))
    met = pieces.join(parts, ["s", "block"], "left")
    overlap = F.greatest(F.lit(0), F.least("high", F.col("at") + F.col("size")) - F.greatest("low", "at")) * F.col("times")
    keys = ["doc_id", "size", "source_size", "target", "s", "at", *carry]
    taken = met.groupBy(*keys).agg(F.sum(F.coalesce(overlap, F.lit(0))).cast("long").alias("taken")).join(_shared(rounds), "s", "left")
    taken = taken.withColumn("taken", F.col("taken") + F.coalesce("rounds", F.lit(0)) * F.col("size"))
    columns = ["doc_id", "size", "source_size", "target", "taken", *carry]
    empty = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return taken.select(*columns).unionByName(empty.select(*columns))
