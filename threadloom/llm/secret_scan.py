"""Secret scans, in DataFrame functions only: three fixed patterns, and two character Markov models compared.

The models are first-order chains over ALPHABET, one for random strings and one for ordinary words and identifiers,
counted from labelled samples with add-one smoothing. The random ones are the fixed patterns' matches in the table and
generated strings in five alphabets; the ordinary ones are the table's words outside such matches and generated
identifiers and numbers. Both come from at most SAMPLE_DOCS documents, chosen by hash, and SAMPLES generated strings.

A candidate (a run of at least SHORTEST characters of ALPHABET) is a secret if the log-likelihood ratio of all its
transitions, random over ordinary, exceeds EVIDENCE and the ratio per transition exceeds MARGIN: a short candidate needs
clearer transitions than a long one. The ratios of all transitions are len(ALPHABET) squared numbers, which go into the
plan as one constant array.

Positions. Spark has no function for them: a text is split by a pattern and the lengths of pieces and matches add up, in
chunks of CHUNK matches and then over the chunks, as a fold copies what it has gathered at every step. Candidates meet
the fixed patterns' spans by chunks as well. So time grows in proportion to a text's length and matches.

Defined results. A null or empty text has no spans. Offsets count code points, ends exclusive. Equal texts in a table give
equal results, repeated rows too. Candidates that overlap a fixed pattern's span are not added. Very long texts and very
long candidates are scanned whole. Without samples of either label both models are uniform and the method adds nothing.
Other columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns; a match of the first counts if its value, and of the others if the whole, is long enough.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
SHORTEST = 12
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
#: Ten nats: the transitions speak for a random string at odds of 22 000 to 1, about as rare as secrets are among words.
EVIDENCE = 10.0
MARGIN = 0.35
#: Labelled samples: generated ones of either kind, and documents whose words and matches are taken.
SAMPLES = 20_000
SAMPLE_DOCS = 2_000
CHUNK = 256


def generated(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(value, secret): random strings in five alphabets and many lengths; identifiers, paths, dates and numbers.

    All come from hashes of a counter, so that every run learns the same.
    """
    alphabets = [ALPHABET, ALPHABET[:62], ALPHABET[26:62], ALPHABET[26:52], "0123456789abcdef"]
    draw = lambda k, j, n: F.pmod(F.xxhash64("id", F.lit(k), j if isinstance(j, Column) else F.lit(j)), F.lit(n))
    letters = F.element_at(F.lit(alphabets), (F.col("id") % len(alphabets) + 1).cast("int"))
    random = F.array_join(F.transform(F.sequence(F.lit(1), 12 + draw(1, 0, 53)), lambda j: F.substring(letters, (F.pmod(F.xxhash64("id", F.lit(2), j), F.length(letters)) + 1).cast("int"), F.lit(1))), "")
    syllables = "the re in er an on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()

    def word(k: int) -> Column:
        return F.concat(*(F.element_at(F.lit(syllables), (draw(10 + k, j, len(syllables)) + 1).cast("int")) for j in range(3)))

    number, digits = draw(3, 0, 3000).cast("string"), F.translate(F.md5(F.col("id").cast("string")), "abcdef", "314159")
    a, b, c, d = (word(k) for k in range(4))
    shapes = [F.concat(a, b, c), F.concat_ws("_", a, b, c, number), F.concat(a, F.initcap(b), F.initcap(c), number), F.concat_ws("/", a, b, c, d), F.concat_ws("-", a, number, b, c), F.upper(F.concat_ws("_", a, b, c)), F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)), F.substring(digits, 1, 16)]
    plain = F.element_at(F.array(*shapes), (F.col("id") % len(shapes) + 1).cast("int"))
    ids = spark.range(n)
    return ids.select(random.alias("value"), F.lit(1).alias("secret")).union(ids.select(plain.alias("value"), F.lit(0).alias("secret")))


def samples(docs: DataFrame, n_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(value, secret): distinct matches of the fixed patterns, and distinct words outside them, of some documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = texts.count()
    texts = texts.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(n)) < n_docs) if n > n_docs else texts
    hexes, access = f"[0-9a-f]{{{LEAST['hex']},}}", f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}"
    values = F.transform(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1)), lambda v: F.when(F.length(v) >= LEAST["assign"], v))
    secrets = F.concat(F.filter(values, lambda v: v.isNotNull()), F.regexp_extract_all("text", F.lit(hexes), F.lit(0)), F.regexp_extract_all("text", F.lit(access), F.lit(0)))
    rest = F.regexp_replace("text", f"{ASSIGN}|{hexes}|{access}", " ")
    found = texts.select(F.explode(secrets).alias("value"), F.lit(1).alias("secret"))
    return found.union(texts.select(F.explode(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{2,}"), F.lit(0))).alias("value"), F.lit(0))).distinct()


def _pairs(places: Column) -> Column:
    """Of places in ALPHABET (0: none) the adjacent two, as one number; 0 where either is none."""
    n, size = F.size(places), len(ALPHABET)
    both = F.zip_with(F.slice(places, F.lit(1), n - 1), F.slice(places, F.lit(2), n - 1), lambda a, b: F.when((a > 0) & (b > 0), (a - 1) * size + b).otherwise(0))
    return F.when(n > 1, both).otherwise(F.array().cast("array<int>"))


def _places(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: F.when(c != "", F.instr(F.lit(ALPHABET), c)).otherwise(0))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios, random over ordinary, of the transitions: place = first * len(ALPHABET) + second."""
    size = len(ALPHABET)
    tables = {0: [0] * size**2, 1: [0] * size**2}
    placed = labelled.where("length(value) > 1").select("secret", _places(F.col("value")).alias("places"))
    for r in placed.select("secret", F.explode(_pairs(F.col("places"))).alias("pair")).where("pair > 0").groupBy("secret", "pair").count().collect():
        tables[r["secret"]][r["pair"] - 1] = r["count"]
    out = []
    for first in range(size):
        rows = {k: tables[k][first * size : (first + 1) * size] for k in (0, 1)}
        out += [math.log((rows[1][j] + 1) / (sum(rows[1]) + size)) - math.log((rows[0][j] + 1) / (sum(rows[0]) + size)) for j in range(size)]
    return out


def _evidence(value: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of all transitions of a candidate."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to a constant
    pairs = F.element_at(F.transform(F.array(_places(value)), _pairs), 1)  # the places are bound, so they are found once
    return F.aggregate(pairs, F.lit(0.0), lambda acc, pair: acc + F.when(pair > 0, F.element_at(table, pair)).otherwise(0.0))


_SPANS = "array<struct<start:int,stop:int,value:string>>"


def _parts(text: Column, pattern: str, found: Column) -> Column:
    """[skipped, value] of a pattern's matches `found`: the length of the piece before each. Only a text with matches is split."""
    skipped = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.zip_with(F.slice(skipped, F.lit(1), F.size(found)), found, lambda p, v: F.struct(p.alias("skipped"), v.alias("value")))
    return F.when(F.size(found) > 0, parts).otherwise(F.array().cast("array<struct<skipped:int,value:string>>"))


def _chunked(array: str) -> Column:
    """The places where the chunks of an array column start."""
    n = F.size(array)
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))


def _local(parts: str) -> Column:
    """Chunks of spans, each counted from its own start: [at (its length), spans]. The column is named twice, so that
    Spark doesn't move its making into the lambda."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + part["skipped"]
        stop = start + F.length(part["value"])
        one = F.struct(start.alias("start"), stop.alias("stop"), part["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    return F.transform(_chunked(parts), lambda first: F.aggregate(F.slice(F.col(parts), first, F.lit(CHUNK)), zero, step))


def _global(chunks: str) -> Column:
    """The spans of all chunks, counted from the text's start."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(chunks, zero, lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
    moved = F.zip_with(chunks, starts, lambda c, at: F.transform(c["spans"], lambda s: F.struct((s["start"] + at).alias("start"), (s["stop"] + at).alias("stop"), s["value"].alias("value"))))
    return F.flatten(moved)


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """One row per document: doc_id, counts of the fixed kinds, their digest, the number of spans added, all spans.

    `ratios` come from train(); by default it learns from generated() and the table's own samples().
    """
    ratios = train(generated(docs.sparkSession).union(samples(docs))) if ratios is None else ratios
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The fixed kinds' least lengths stand in the patterns where that finds the same matches: whole runs.
    access, hexes = f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", f"[0-9a-f]{{{LEAST['hex']},}}"
    patterns = {"assign": ASSIGN, "access": access, "hex": hexes, "markov": CANDIDATE}
    random = lambda v: (_evidence(v, ratios) > F.greatest(F.lit(EVIDENCE), MARGIN * (F.length(v) - 1)))
    rows = rows.select("doc_id", "text", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"f_{k}") for k, p in patterns.items()))
    # Only a text with a random candidate is split at its candidates.
    rows = rows.withColumn("f_random", F.transform("f_markov", random))
    rows = rows.withColumn("f_markov", F.when(F.exists("f_random", lambda x: x), F.col("f_markov")).otherwise(F.array().cast("array<string>")))
    rows = rows.select("doc_id", "f_random", *(_parts(F.col("text"), p, F.col(f"f_{k}")).alias(k) for k, p in patterns.items()))
    rows = rows.select("doc_id", "f_random", *(_local(k).alias(k) for k in patterns))
    rows = rows.select("doc_id", "f_random", *(_global(k).alias(k) for k in patterns))
    long_enough = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= LEAST["assign"]
    chosen = F.filter(F.zip_with("markov", F.when(F.size("markov") > 0, F.col("f_random")).otherwise(F.array().cast("array<boolean>")), lambda s, r: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), r.alias("random"))), lambda s: s["random"])
    rows = rows.withColumn("assign", F.filter("assign", long_enough)).withColumn("markov", chosen)
    base = F.array_sort(F.concat(*(_tagged(F.col(k), i) for i, k in enumerate(KINDS[:3]))))
    rows = rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), base.alias("base"), _tagged(F.col("markov"), 3).alias("added"))
    blocks = F.transform(_chunked("base"), lambda first: F.slice(F.col("base"), first, F.lit(CHUNK)))
    bounded = F.transform(blocks, lambda b: F.struct(F.element_at(b, 1)["start"].alias("low"), F.array_max(F.transform(b, lambda s: s["stop"])).alias("high"), b.alias("spans")))
    rows = rows.withColumn("blocks", bounded)
    meets = lambda s: F.exists("blocks", lambda b: (b["low"] < s["stop"]) & (s["start"] < b["high"]) & F.exists(b["spans"], lambda x: (x["start"] < s["stop"]) & (s["start"] < x["stop"])))
    rows = rows.withColumn("added", F.when(F.size("blocks") > 0, F.filter("added", lambda s: ~meets(s))).otherwise(F.col("added")))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), F.size("added").cast("long").alias("n_added"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
