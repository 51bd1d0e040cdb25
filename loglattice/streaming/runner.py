"""Running a stream over what its source holds, and idempotent batch sinks."""

from __future__ import annotations

import logging
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..session import list_names, path_exists
from .committed import Tables, newest_of

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class StreamRun:
    """What one run of a stream did."""

    success: bool
    rows_late: int = 0

    def checked(self) -> StreamRun:
        """Itself, or an error for callers that read the output right away."""
        if not self.success:
            raise RuntimeError("the stream failed; see the log")
        return self


def run_available(writer: DataStreamWriter, checkpoint: str) -> StreamRun:
    """Process everything there is and stop. Failures are logged, not raised:
    the checkpoint lets the next run take up where this one stopped."""
    query = None
    try:
        query = (
            writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        success = True
    except (PySparkException, Py4JError) as error:
        logger.error("stream failed: %s", error)
        success = False
    progress = query.recentProgress if query else []
    return StreamRun(
        success,
        sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]),
    )


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The name under which a checkpoint's stream writes, made up once and kept in it.

    Batch ids start at zero with every checkpoint; only together with this name
    do they tell a batch from those of other streams, or of a lost checkpoint. Names
    sort by when the stream began.
    """
    path = f"{checkpoint.rstrip('/')}/stream-name"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        name = f"s{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").text(path)
    return spark.read.text(path).first()["value"]


def write_batch(
    df: DataFrame, path: str, batch_id: int, partitions: tuple[str, ...] = (), stream: str = "s0"
) -> None:
    """Write a micro-batch under its stream's name and its own `batch_id`,
    replacing what an earlier attempt at the same batch left there."""
    (
        df.withColumn("stream", F.lit(stream))
        .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions, "stream", "batch_id")
        .parquet(path)
    )


def write_changes(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamRun:
    """Run an aggregation in update mode, keeping the newest state of each key."""
    spark = stream.sparkSession
    name = stream_name(spark, checkpoint)
    writer = stream.writeStream.outputMode("update").foreachBatch(
        lambda df, batch_id: add_changes(df, batch_id, path, keys, name)
    )
    run = run_available(writer, checkpoint)
    if run.success:
        change_table(spark, path, keys, name).mark_caught_up()
    return run


def change_table(spark: SparkSession, path: str, keys: list[str], stream: str) -> Tables:
    """The table of one stream's changes, below its own name."""
    return Tables(spark, f"{path.rstrip('/')}/{stream}", {"changes": newest_of(keys)})


def add_changes(rows: DataFrame, batch_id: int, path: str, keys: list[str], stream: str = "s0") -> None:
    """Add a batch's rows to its stream's table, once."""
    numbered = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    table = change_table(rows.sparkSession, path, keys, stream)
    table.commit(stream, batch_id, lambda _: {"changes": lambda _: numbered})


def newest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest state of each key, by one stream.

    A lost checkpoint starts a stream anew, and that goes through the source from its start; names order streams by their
    start. The newest one that has once reached the end of its source counts, or the newest of all if none has: rows of
    two streams are never mixed.
    """
    names = sorted(list_names(spark, path), reverse=True)
    if not names:
        raise FileNotFoundError(f"no stream has written to {path}")
    tables = [change_table(spark, path, keys, name) for name in names]
    chosen = next((t for t in tables if t.state().caught_up), tables[0])
    return chosen.read("changes").drop("batch_id")
