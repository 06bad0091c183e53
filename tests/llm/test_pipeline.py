from __future__ import annotations

import random
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import mixing, packing, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    shared = "this line of boilerplate stands in very many of the documents here"
    rows = []
    for i in range(90):
        body = " ".join(f"word{rng.randrange(300)}" for _ in range(rng.randrange(60, 200)))
        rows.append((i, f"{shared}\n{body}" if i % 3 == 0 else body, "en", f"s{i % 4 if i % 2 else 0}", 7))
    rows += [(200 + i, rows[5][1] + f" extra{i}", "en", "s1", 7) for i in range(4)]
    rows += [(300, "too short", "en", "s1", 9), (301, None, None, None, None), (302, "", "en", None, 0), (303, "&&& " * 90, "en", "s2", 1)]
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, outputs = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        outputs[name] = docs
    verdicts = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(verdicts[r[0]] != brute.base_statistics(r[1])[-1] or not verdicts[r[0]] for r in rows)
    kept = [r for r in rows if verdicts[r[0]]]
    assert sorted(map(tuple, outputs["quality_rules"].collect())) == sorted(kept)
    texts = {d: t for d, _, _, t in brute.line_dedup([(r[0], r[1]) for r in kept])}
    lined = [(r[0], texts[r[0]], *r[2:]) for r in kept]
    assert sorted(map(tuple, outputs["line_dedup"].collect())) == sorted(lined)
    groups = brute.near_duplicates([(r[0], r[1]) for r in lined], 5, 80)
    unique = [r for r in lined if groups[r[0]] == r[0]]
    assert sorted(map(tuple, outputs["near_dedup"].collect())) == sorted(unique)
    taken = {r["doc_id"]: int(np.floor(r["taken"] / r["size"] + 0.5)) for r in mixing.mix(spark.createDataFrame(unique, DOCS)).collect() if r["size"]}
    mixed = Counter({r: taken.get(r[0], 0) for r in unique})
    assert Counter(map(tuple, outputs["source_mixing"].collect())) == +mixed
    pieces = outputs["packing"].collect()
    encoder = packing.Encoder(packing._vocabulary())
    want = sum((len(encoder.encode(r[1])) // 4 + 1) * n for r, n in mixed.items())
    assert sum(r["length"] for r in pieces) == want
    whole = sorted(r["sequence_id"] * 1024 + r["offset"] for r in pieces)
    assert whole[0] == 0 and {c for n, c in corpus_pipeline.STAGES} and len(set(whole)) == len(whole)


def test_rows_without_or_with_a_shared_doc_id(spark):
    rng = random.Random(4)
    # As many words as no other row has, so that the mix's order of rows without an id is fixed.
    text = lambda i: " ".join(f"word{rng.randrange(300)}" for _ in range(60 + i))
    clean = [(None if i % 2 else i, text(i), "en", f"s{i % 4 if i % 3 else 0}", 7) for i in range(40)]
    clean += [clean[1], (50, text(50), "en", "s1", 7), (50, text(51), "en", "s1", None)]
    bad = [(None, "too short", "en", "s1", 9), (50, "&&& " * 90, "en", "s1", 7), (None, None, None, None, None)]
    docs = spark.createDataFrame(clean + bad, DOCS).repartition(3)
    got = [tuple(r) for r in corpus_pipeline.quality_rules(spark, docs, "").collect()]
    assert Counter(got) == Counter(clean)
    docs = spark.createDataFrame(clean, DOCS)
    taken = mixing.mix(docs, {"all": F.struct(*docs.columns)}).collect()
    want = Counter()
    for r in taken:
        want[tuple(r["all"])] += int(np.floor(r["taken"] / r["size"] + 0.5))
    assert Counter(tuple(r) for r in corpus_pipeline.source_mixing(spark, docs, "").collect()) == +want
    assert len({n for r, n in want.items() if r[0] is None}) > 1


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    last = got.agg(F.max(F.col("sequence_id") * 1024 + F.col("offset") + F.col("length")).alias("end"), F.sum("length").alias("n")).first()
    assert last["end"] == last["n"] > 0


def test_odd_documents(spark, tmp_path):
    """Clashing names, repeated rows, nulls in any column, and a text of a megabyte."""
    rng = random.Random(6)
    names = ("kept", "n_words", "size", "taken", "key", "class", "grp", "slot", "s", "n", "print", "start", "ids")
    long = "\n".join(" ".join(f"word{rng.randrange(30_000)}" for _ in range(60)) for _ in range(2_000))
    body = lambda: " ".join(f"word{rng.randrange(300)}" for _ in range(80))
    rows = [(i, body(), "en", f"s{i % 3}", 7) for i in range(30)] + [(100, long, None, "s1", 1), (101, body(), "en", None, None), (None, body(), None, None, None), (102, None, "en", "s1", 0)]
    rows += [rows[0], rows[0]]
    frame = spark.createDataFrame(rows, DOCS).select("*", *(F.lit("x").alias(c) for c in names))
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == frame.columns
        got = Counter(r["doc_id"] for r in docs.collect())
        assert 102 not in got and {100, 101, None} <= set(got), name
        if name == "near_dedup":
            assert got == Counter({r[0]: 1 for r in rows if r[0] != 102})
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == set(got) and any(r["start"] > 100_000 for r in pieces)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
