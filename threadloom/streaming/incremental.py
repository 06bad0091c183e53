"""Incremental ingest: new conversation files stream in; each conversation's latest text is kept once.

An extension: the archive itself is a batch product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

TURNS = "conv_id long, turn long, role string, text string"


def turns(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(TURNS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def representations(rows: DataFrame) -> DataFrame:
    """conv_id, text, text_sha256, turns of a batch of turns."""
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("ts"))
    text = F.array_join(F.transform("ts", lambda t: F.concat(F.initcap(t["role"]), F.lit(":\n"), t["text"])), "\n\n")
    return whole.select("conv_id", text.alias("text"), F.sha2(text, 256).alias("text_sha256"), F.size("ts").cast("long").alias("turns"))


def keep_latest(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's representations under its batch number: a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        representations(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The longest, then latest, representation of each conversation."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turns"), F.desc("batch")))
    return spark.read.parquet(folder).withColumn("_r", rank).where("_r = 1").drop("_r")
