"""Streams of search logs and runs: daily counts with late rows, retries, retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events by day and type; works on a stream (rows later than `late` are left out) and on a table."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of each user's events with no gap longer than `gap`."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    return stamped.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "n")


def process_pending(pending: DataFrame, attempt: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of pending rows goes through `attempt` once; results are
    written under the batch's id, so a batch that is repeated replaces itself."""

    def one(batch: DataFrame, n: int) -> None:
        attempt(batch).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return pending.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
