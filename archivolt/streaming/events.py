"""Streaming forms, an addition to the batch operators: incremental upserts and sessions over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, ts: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by key and window; later rows than the watermark are dropped by the engine."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, width).alias("w"), F.col(key))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), key, "n", "total")
    )


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by key that end after a gap."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("w"), F.col(key))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def upsert_stream(changes: DataFrame, path: str, key: list[str], version: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's newest row per key to a table by batch; readers take the newest with ``latest``."""

    def store(batch: DataFrame, number: int) -> None:
        rows = [c for c in batch.columns if c not in key]
        newest = batch.groupBy(*key).agg(F.max_by(F.struct(*rows), version).alias("r")).select(*key, "r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(stored: DataFrame, key: list[str], version: str) -> DataFrame:
    """The newest row of each key."""
    rows = [c for c in stored.columns if c not in key]
    return stored.groupBy(*key).agg(F.max_by(F.struct(*rows), version).alias("r")).select(*key, "r.*")
