"""From raw documents to packed sequences, in five stages; each takes what the one before it has written.

Defined results. A null or empty text fails the base rules and goes. Rows are judged each by its own text, with or without a
doc_id; rows that equal each other in all columns are judged alike, and of rows that share a doc_id the near-duplicate stage
keeps one. Of equally good copies the smallest doc_id stays. Very long texts go through whole. Other columns, whatever their
names, stay with their rows up to the last stage, but for names that begin with _tl_. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm import common, line_dedup, mixing, near_dup, packing
from threadloom.llm import quality_rules as rules


#: Near copies in this pipeline: words in a shingle, least similarity in percent.
SHINGLE, THRESHOLD = 5, 80
#: Two hashes of all columns of a row: what is decided on a row is carried back to it and to rows that equal it.
ROW = ["_tl_row", "_tl_twin"]


def _row(docs: DataFrame) -> dict[str, Column]:
    """The columns ROW. A hash leaves nulls out, so it takes in which columns are null."""
    columns = [F.col(c) for c in docs.columns]
    return {name: F.xxhash64(F.lit(seed), *columns, *(c.isNull() for c in columns)) for seed, name in enumerate(ROW)}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, each by its own text, whether or not it has a doc_id or shares one."""
    rejected = rules.quality_rules(docs, _row(docs)).where("not kept").select(*ROW).distinct()
    return docs.withColumns(_row(docs)).join(rejected, ROW, "left_anti").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its text without the lines that it loses."""
    out = line_dedup.dedup_lines(docs, docs.columns)
    text = F.when(F.col("_tl_runs").isNull(), F.col("text")).otherwise(F.col("_tl_kept"))
    return out.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; of rows that repeat its doc_id, one. Rows without a doc_id stay."""
    kept = near_dup.near_duplicates(docs, SHINGLE, THRESHOLD).where("kept and doc_id is not null").select(F.col("doc_id").alias("_tl_doc")).distinct()
    out = docs.join(kept, docs["doc_id"] == kept["_tl_doc"], "left").where("_tl_doc is not null or doc_id is null")
    # The join has dealt the rows by doc_id, so the window needs no further exchange.
    nameless = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    first = F.row_number().over(Window.partitionBy("doc_id", "_tl_nameless").orderBy("text"))
    return out.withColumn("_tl_nameless", nameless).withColumn("_tl_row", first).where("_tl_row = 1").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, a part of it rounded; those that it doesn't take go."""
    taken = mixing.mix(docs, _row(docs)).select(*ROW, F.round(F.try_divide("taken", "size")).cast("int").alias("_tl_times")).where("_tl_times > 0")
    # Of equal rows, one stands for all: it comes as often as the mix takes them together.
    times = taken.groupBy(*ROW).agg(F.sum("_tl_times").cast("int").alias("_tl_times"))
    met = docs.withColumns(_row(docs)).join(times, ROW)
    one = met.withColumn("_tl_nth", F.row_number().over(Window.partitionBy(*ROW).orderBy(*ROW))).where("_tl_nth = 1")
    return one.withColumn("_tl_copy", F.explode(F.sequence(F.lit(1), F.col("_tl_times")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, with their ids as little-endian unsigned 32-bit numbers."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("packing", pack_sequences),
]
#: Robust estimates, minima and tokens have no SQL: tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared checkpoint folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    base = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
