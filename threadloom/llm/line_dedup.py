"""Line dedup, in DataFrame functions only: lines that many documents share stay in one of them.

A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least LEAST_CHARS code points that at
least LEAST_DOCS documents hold lose all their lines except in the document with the largest doc_id.

Only 128-bit hashes of keys move, with document and position, stored once: they are range-partitioned by hash and salt
and sorted within by document and position, so a window streams over each group and sees every document's first
occurrence. The salt depends on the document: a line that a third of all documents hold lies in as many groups as keep
each below GROUP rows, whose counts and largest doc_id meet afterwards, a row each. What comes back to a document is its
keep bitmap, compressed to the runs of zeros. Texts stay where they are, but for those that a bit filter of the losing
documents, at most MOST_BUCKETS * 4 kB, lets pass to meet their bitmaps.

Defined results. A null or empty text is one empty line, which has no key. A null doc_id counts as a document below all
others. Rows that share doc_id count as one document, and each loses its own lines; a line that a document repeats is one
occurrence. Very long texts are split whole. Other columns, whatever their names, are kept out of the way. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import ascii_lower, partitions, stored, strip_blanks

LEAST_CHARS = 40
LEAST_DOCS = 5
#: Rows of a key and salt at most, if a key holds a third of all; salts at least.
GROUP = 1_000_000
SALTS = 64
#: Bits of the filter for each losing document, and its 4 kB buckets at most.
BITS = 16
MOST_BUCKETS = 8192
_BUCKET = 8 * 4096


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _places(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), the two halves of a key's hash, and the line's position."""
    line = F.posexplode(lines_of(F.col("text"))).alias("position", "line")
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), line)
    # Blanks at the ends can only shorten a line: most short lines go before any more work.
    stripped = lines.where(F.char_length("line") >= LEAST_CHARS).withColumn("line", strip_blanks(F.col("line"))).where(F.char_length("line") >= LEAST_CHARS)
    key = ascii_lower(F.col("line"))
    return stripped.withColumn("line", key).select("doc_id", "row", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "position")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row, and `runs`: [first, count] of dropped lines, for the documents that lose any."""
    places = stored(_places(docs))
    n_salts = max(SALTS, -(-places.count() // (3 * GROUP)))
    places = places.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(n_salts)).cast("int"))
    group = ["h1", "h2", "salt"]
    dealt = places.repartitionByRange(partitions(docs), *group).sortWithinPartitions(*group, "doc_id", "position")
    stream = Window.partitionBy(*group).orderBy("doc_id", "position")
    same = F.lag("doc_id").over(stream).eqNullSafe(F.col("doc_id")) & (F.row_number().over(stream) > 1)
    seen = dealt.withColumn("first", (~same).cast("int"))
    sums = seen.groupBy(*group).agg(F.sum("first").alias("n"), F.max("doc_id").alias("top"))
    # A key's salts, one row each, learn the counts and the largest doc_id of the key.
    every = Window.partitionBy("h1", "h2")
    shared = stored(sums.select(*group, F.sum("n").over(every).alias("n"), F.max("top").over(every).alias("top")).where(F.col("n") >= LEAST_DOCS))
    lost = places.join(shared, group).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    return lost.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("position")).alias("gone")).select("doc_id", "row", _runs(F.col("gone")).alias("runs"))


def _runs(gone: Column) -> Column:
    """Sorted positions as [first, count] runs."""
    firsts = F.filter(gone, lambda x, i: (i == 0) | (F.element_at(gone, F.greatest(i, F.lit(1))) != x - 1))
    lasts = F.filter(gone, lambda x, i: (i == F.size(gone) - 1) | (F.element_at(gone, F.least(i + 2, F.size(gone))) != x + 1))
    return F.transform(F.arrays_zip(firsts.alias("a"), lasts.alias("b")), lambda r: F.array(r["a"], r["b"] - r["a"] + 1))


def _kept(text: Column, runs: Column) -> Column:
    """The text without the runs' lines: the slices between them, each taken once."""
    lines = lines_of(text)
    ends = F.concat(F.array(F.array(F.lit(0), F.lit(0))), runs)
    starts = F.transform(ends, lambda r: r[0] + r[1])
    stops = F.concat(F.transform(runs, lambda r: r[0]), F.array(F.size(lines)))
    pieces = F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.when(runs.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.flatten(pieces), "\n"))


def _filter(lost: DataFrame) -> Column:
    """Whether a row with _tl_id and _tl_text may lose lines: two bits of a map of the documents that do."""
    n_buckets = min(MOST_BUCKETS, max(1, -(-lost.count() * BITS // _BUCKET)))

    def place(seed: int, doc_id: str, row: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), doc_id, row), F.lit(n_buckets * _BUCKET))

    spots = lost.select(F.explode(F.array(*(place(k, "doc_id", "row") + 1 for k in (1, 2)))).alias("p"))
    maps = spots.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    found = {r["bucket"]: bytes(r["bits"]) for r in maps}
    whole = F.lit(bytearray(b"".join(found.get(k + 1, bytes(4096)) for k in range(n_buckets))))

    def bit(p: Column) -> Column:
        octet = F.conv(F.hex(F.substring(whole, F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(octet, (p % 8).cast("int")) == 1

    return bit(place(1, "_tl_id", "_tl_text")) & bit(place(2, "_tl_id", "_tl_text"))


def dedup_lines(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The documents (doc_id, or `columns`) with n_lines, n_dropped, runs (the bitmap; null: all stay) and kept_text."""
    columns = columns or ["doc_id"]
    lost = stored(dropped_lines(docs))
    rows = docs.select(*dict.fromkeys([*columns, "doc_id", "text"])).withColumn("_tl_id", F.col("doc_id").cast("long")).withColumn("_tl_text", F.xxhash64("text"))
    may = _filter(lost)
    lost = lost.select(F.col("doc_id").alias("_tl_doc"), F.col("row").alias("_tl_row"), F.col("runs").alias("_tl_runs"))
    met = rows.where(may).join(lost, F.col("_tl_id").eqNullSafe(F.col("_tl_doc")) & (F.col("_tl_text") == F.col("_tl_row")), "left").drop("_tl_doc", "_tl_row")
    met = met.unionByName(rows.where(~may).withColumn("_tl_runs", F.lit(None).cast(lost.schema["_tl_runs"].dataType)))
    n_dropped = F.coalesce(F.aggregate("_tl_runs", F.lit(0), lambda a, r: a + r[1]), F.lit(0)).cast("long")
    return met.select(*columns, F.size(lines_of(F.col("text"))).cast("long").alias("_tl_lines"), n_dropped.alias("_tl_dropped"), "_tl_runs", _kept(F.col("text"), F.col("_tl_runs")).alias("_tl_kept"))


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.top AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
