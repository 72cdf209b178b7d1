"""Structured Streaming: incremental re-analysis of a folder, and windows over events (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions import hashing
from loomgraph.functions import text as T
from loomgraph.operators import incremental
from loomgraph.shared import store


def watch_files(spark: SparkSession, folder: str, checkpoint: str, stored: Callable[[], DataFrame], on_change: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each batch of arriving (path, content) Parquet rows is hashed and compared with ``stored()``; new and changed files go to ``on_change``."""
    rows = spark.readStream.schema("path string, content string").parquet(folder).filter(T.is_included(F.col("path")))

    def batch(df: DataFrame, number: int) -> None:
        incoming = store(df.withColumn("hash", hashing.hash_file(F.col("path"), F.col("content"))), "incoming")
        changes = incremental.needs_parse(incremental.diff(stored(), incoming.select("path", "hash")))
        on_change(incoming.join(changes, "path", "left_semi"), number)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type in tumbling windows, with a watermark; the same plan for batch and stream."""
    w = F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "user_id", "n")
