"""Places and running sums over a total order, without one task that holds it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(df: DataFrame, order: list[str | Column], cut: Callable[[DataFrame], DataFrame], sums: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """`df` with `place` (from 0) and, for each of `sums`, `before_<name>`: the sum over the rows ahead.

    Rows are range-partitioned and sorted; `cut` must write the result down, as a range's bounds are drawn from a sample.
    Each partition's count and sums, one row a partition, are added up on the driver; what lies ahead within a partition
    is a window over that partition. Rows that tie have neighbouring places, in either order.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_order_at", F.monotonically_increasing_id()))
    part = F.shiftright("_order_at", 33)  # how monotonically_increasing_id numbers the rows of a partition
    names = ["place", *(f"before_{c}" for c in sums)]
    totals = laid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("place"), *(F.sum(c).alias(f"before_{c}") for c in sums)).orderBy("part")
    offsets, ahead = [], None
    for r in totals.collect():
        ahead = ahead or [0 * (r[c] or 0) for c in names]
        offsets.append((r["part"], *ahead))
        ahead = [x + (r[c] or 0) for c, x in zip(names, ahead)]
    offsets = laid.sparkSession.createDataFrame(offsets, totals.schema).select(F.col("part").alias("_order_part"), *(F.col(c).alias(f"_order_{c}") for c in names))
    window = Window.partitionBy("_order_part").orderBy("_order_at")
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    met = laid.withColumn("_order_part", part).join(F.broadcast(offsets), "_order_part")
    met = met.withColumn("place", F.col("_order_place") + F.row_number().over(window) - 1)
    for c in names[1:]:
        met = met.withColumn(c, F.col(f"_order_{c}") + F.coalesce(F.sum(c[7:]).over(before), F.lit(0)))
    return met.drop("_order_part", "_order_at", *(f"_order_{c}" for c in names))
