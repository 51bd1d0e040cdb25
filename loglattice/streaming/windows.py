"""Event-time aggregations. Rows more than ten minutes late are dropped and
counted by the run.

Each keeps one fixed-size state row per key and window, freed once the
watermark passes; the totals are rolled up from the change table on reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import mean_of
from ..operators.log_reports import session_depth_of, session_parts
from .runner import StreamRun, newest_rows, write_changes

LATENESS = "10 minutes"
HOUR, WINDOW = ["hour_start"], ["client_ip", "window_start"]
SESSION = ["session_id", "search_campaign", "endpoint_path"]


def stream_hourly_traffic(log: DataFrame, path: str, checkpoint: str) -> StreamRun:
    """Requests and latency per clock hour."""
    hours = (
        log.withWatermark("request_timestamp", LATENESS)
        .groupBy(F.window("request_timestamp", "1 hour").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("response_time_ms").alias("ms"),
            F.count("response_time_ms").alias("n_ms"),
        )
    )
    return write_changes(
        hours.select(F.col("w.start").alias("hour_start"), "n", "ms", "n_ms"), path, checkpoint, HOUR
    )


def hourly_traffic_from(spark: SparkSession, path: str) -> DataFrame:
    """Requests and average latency by hour of day."""
    hours = newest_rows(spark, path, HOUR)
    return (
        hours.groupBy(F.hour("hour_start").alias("hour_of_day"))
        .agg(
            F.sum("n").alias("requests"),
            mean_of(F.sum("ms"), F.sum("n_ms")).alias("avg_latency_ms"),
        )
        .orderBy("hour_of_day")
    )


def stream_rate_limit(
    requests: DataFrame, path: str, checkpoint: str, window: str = "1 minute"
) -> StreamRun:
    """Requests per address and window."""
    counts = (
        requests.withWatermark("ts", LATENESS)
        .groupBy("client_ip", F.window("ts", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return write_changes(
        counts.select("client_ip", F.col("w.start").alias("window_start"), "n"), path, checkpoint, WINDOW
    )


def rate_limit_from(spark: SparkSession, path: str, limit: int = 10) -> DataFrame:
    """Requests and how many of them were over the limit, per address and window."""
    counts = newest_rows(spark, path, WINDOW)
    return counts.select(
        "client_ip",
        "window_start",
        F.col("n").alias("requests"),
        F.greatest(F.col("n") - limit, F.lit(0)).alias("rejected"),
    )


def stream_session_depth(log: DataFrame, path: str, checkpoint: str) -> StreamRun:
    """Parts of sessions per day, see `session_parts`."""
    staged = log.where(F.col("funnel_stage").isNotNull()).withWatermark(
        "request_timestamp", LATENESS
    )
    day = F.window("request_timestamp", "1 day").alias("w")
    parts = session_parts(staged, day).withColumn("day_start", F.col("w.start")).drop("w")
    return write_changes(parts, path, checkpoint, [*SESSION, "day_start"])


def session_depth_from(spark: SparkSession, path: str) -> DataFrame:
    """Per campaign averages of all sessions seen."""
    parts = newest_rows(spark, path, [*SESSION, "day_start"])
    merged = parts.groupBy(*SESSION).agg(
        F.max("converted").alias("converted"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
    )
    return session_depth_of(merged)
