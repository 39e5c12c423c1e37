"""Intervals on a line: frontier gaps, islands, unions, complements; one sort per key each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frontier_gaps(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines (s, e, prim_id) with prev_e: the greatest end of those before it in order."""
    before = Window.partitionBy(*keys).orderBy("s", F.col("e").desc(), "prim_id").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("prev_e", F.max("e").over(before)).withColumn("prev_id", F.max(F.struct("e", "prim_id")).over(before)["prim_id"])


def islands(lines: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Merged runs: (keys, island, s, e, parts, covered_gap) of lines no more than gap apart."""
    order = Window.partitionBy(*keys).orderBy("s", F.col("e").desc(), "prim_id")
    marked = lines.withColumn("frontier", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("island", F.sum(F.when(F.col("frontier").isNull() | (F.col("s") > F.col("frontier") + gap), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    holes = F.sum(F.greatest(F.lit(0.0), F.when(F.col("s") <= F.col("frontier") + gap, F.col("s") - F.col("frontier")).otherwise(0.0)))
    return marked.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("parts"), holes.alias("holes"))
