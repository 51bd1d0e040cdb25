"""The sync into committed tables: warehouse rows and the bitmap ledger change together.

A batch compares its ids with the ledger's bitmaps, not with the warehouse, so loading costs the same however
many batches came before. Rows and ledger become visible by one manifest: a crash at any step leaves both or neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.id_ledger import bitmap_ledger, merged_ledger, new_rows
from ..operators.sync import to_warehouse
from ..schemas import LIVE_LOG
from ..session import path_exists
from .committed import State, Tables
from .logs import logger, summary
from .runner import run_available, stream_name


def warehouse_tables(spark: SparkSession, path: str) -> Tables:
    """`rows`, by day, and `ledger`, (bucket, bitmap)."""
    return Tables(spark, path, {"rows": None, "ledger": merged_ledger}, {"rows": ["date"]})


def load_into(tables: Tables, log: DataFrame, batch_id: int, stream: str = "s0") -> tuple[int, int]:
    """Load one micro-batch; rows fetched and rows loaded.

    An id is loaded once, whatever stream, day or checkpoint it comes from; of several rows in this batch the
    earliest. Rows without an id cannot be told from repeats: they are fetched, never loaded. Streams may load at the same time:
    the later one to publish looks at its ids again.
    """
    rows = to_warehouse(log)
    bucket = F.bitmap_bucket_number("query_id")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.min(bucket).alias("low"), F.max(bucket).alias("high")).first()
    if not facts["n"]:
        return 0, 0
    rest = [c for c in rows.columns if c not in ("query_id", "request_timestamp")]
    first = F.min(F.struct("request_timestamp", *rest)).alias("first")
    once = rows.where(F.col("query_id").isNotNull()).groupBy("query_id").agg(first)
    once = once.select("query_id", "first.*").select(rows.columns)

    def build(state: State) -> dict:
        known = tables.read("ledger", state)
        fresh = once
        if known is not None:
            fresh = new_rows(once, known.where(F.col("bucket").between(facts["low"], facts["high"])))
        return {"rows": lambda _: fresh, "ledger": lambda done: bitmap_ledger(done["rows"]).sortWithinPartitions("bucket")}

    written = tables.commit(stream, batch_id, build)
    return facts["n"], written["rows"].count() if written else 0


def run_sync_table(
    spark: SparkSession, source: str, path: str, checkpoint: str, max_files: int | None = None
) -> DataFrame:
    """Sync what is new in the live log into the tables at `path`; one summary row, as `logs.run_sync`."""
    if not path_exists(spark, source):
        logger.error("nothing to sync at %s", source)
        return summary(spark, 0, 0, False)
    reader = spark.readStream.schema(LIVE_LOG)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    tables, counts = warehouse_tables(spark, path), []
    name = stream_name(spark, checkpoint)
    writer = reader.parquet(source).writeStream.foreachBatch(
        lambda df, batch_id: counts.append(load_into(tables, df, batch_id, name))
    )
    run = run_available(writer, checkpoint)
    return summary(spark, sum(c[0] for c in counts), sum(c[1] for c in counts), run.success)
