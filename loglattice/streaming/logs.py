"""Appending served requests, and loading each of them into the warehouse once."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import weak_matches
from ..operators.sync import enrich_requests, to_warehouse
from ..schemas import LIVE_LOG
from ..session import path_exists
from .runner import StreamRun, run_available, stream_name, write_batch

logger = logging.getLogger(__name__)


def append_log_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamRun:
    """Append a stream of log rows to a parquet log."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", path)
    return run_available(writer, checkpoint)


def stream_log_ingest(raw: DataFrame, path: str, checkpoint: str) -> StreamRun:
    """Enrich a stream of raw requests and append them to the live log."""
    return append_log_stream(enrich_requests(raw), path, checkpoint)


def stream_weak_matches(results: DataFrame, path: str, checkpoint: str) -> StreamRun:
    """Append weak matches to the JSON-lines log as results arrive.

    The file sink's own log makes a batch that is tried again appear once.
    """
    writer = (
        weak_matches(results, asked_at=F.col("asked_at"))
        .writeStream.outputMode("append").format("json").option("path", path)
    )
    return run_available(writer, checkpoint)


def load_batch(
    log: DataFrame, batch_id: int, warehouse: str, ledger: str, stream: str = "s0"
) -> tuple[int, int]:
    """Load one micro-batch, record its ids; rows fetched and rows loaded.

    An id that comes twice is loaded once, whatever day, stream or checkpoint it
    came from before; of several rows in this batch the earliest. Rows without an id
    cannot be told from repeats: they are fetched, never loaded. Both writes
    replace what this batch of this stream left, so a crash between them, or in
    the middle of one, is repaired by running the batch again. Two streams
    loading one warehouse must take turns, or ids both fetch meanwhile come twice.
    """
    spark = log.sparkSession
    rows = to_warehouse(log)
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("query_id").alias("low"), F.max("query_id").alias("high")
    ).first()
    if not facts["n"]:
        return 0, 0
    rest = [c for c in rows.columns if c not in ("query_id", "request_timestamp")]
    first = F.min(F.struct("request_timestamp", *rest)).alias("first")
    fresh = rows.where(F.col("query_id").isNotNull()).groupBy("query_id").agg(first).select("query_id", "first.*").select(rows.columns)
    own = (F.col("stream") == stream) & (F.col("batch_id") == batch_id)
    if path_exists(spark, warehouse):
        # One column of the row groups that can hold one of the ids.
        others = spark.read.parquet(warehouse).where(
            F.col("query_id").between(facts["low"], facts["high"]) & ~own
        )
        fresh = fresh.join(others.select("query_id"), "query_id", "left_anti")
    write_batch(fresh.hint("rebalance", "date"), warehouse, batch_id, ("date",), stream)
    if not path_exists(spark, warehouse):
        return facts["n"], 0
    # counted in the table: a figure gathered while writing may count a task
    # twice that was run again
    written = spark.read.parquet(warehouse).where(own)
    ids = written.select("query_id", F.current_timestamp().alias("synced_at"))
    write_batch(ids, ledger, batch_id, (), stream)
    return facts["n"], written.count()


def run_sync(
    spark: SparkSession,
    source: str,
    warehouse: str,
    ledger: str,
    checkpoint: str,
    max_files: int | None = None,
) -> DataFrame:
    """Sync what is new in the live log; one summary row.

    The checkpoint takes the place of a synced flag, and the scheduler that
    calls this decides the cadence. `max_files` bounds a micro-batch.
    """
    if not path_exists(spark, source):
        logger.error("nothing to sync at %s", source)
        return summary(spark, 0, 0, False)
    reader = spark.readStream.schema(LIVE_LOG)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return sync_stream(reader.parquet(source), warehouse, ledger, checkpoint)


def sync_stream(log: DataFrame, warehouse: str, ledger: str, checkpoint: str) -> DataFrame:
    """The same from a stream of live-log rows."""
    counts: list[tuple[int, int]] = []
    name = stream_name(log.sparkSession, checkpoint)
    writer = log.writeStream.foreachBatch(
        lambda df, batch_id: counts.append(load_batch(df, batch_id, warehouse, ledger, name))
    )
    run = run_available(writer, checkpoint)
    fetched, loaded = sum(c[0] for c in counts), sum(c[1] for c in counts)
    return summary(log.sparkSession, fetched, loaded, run.success)


def summary(spark: SparkSession, fetched: int, loaded: int, success: bool) -> DataFrame:
    """The summary row of a sync."""
    return spark.range(1).select(
        F.lit(fetched).alias("records_fetched"),
        F.lit(loaded).alias("records_loaded"),
        F.lit(success).alias("success"),
        F.current_timestamp().alias("timestamp"),
    )
