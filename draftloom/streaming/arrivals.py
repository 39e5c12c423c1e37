"""Documents and telemetry as they arrive: windows, sessions, latest results, exactly-once batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.registry import query


def durations(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and type of event; of a stream, late ones go after the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events no more than gap apart."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def latest(runs: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first event of each id within the watermark: repeats of a delivery go."""
    return runs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def process(arriving: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """operator over each batch of arriving primitives; a batch that is repeated after a failure overwrites its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        operator(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


query("event_windows", "", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2")(lambda load: durations(load("events")))
query("event_sessions", "", """
SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events}) e) s GROUP BY user_id, session""")(lambda load: sessions(load("events")))
