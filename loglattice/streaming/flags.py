"""Timed flags over a stream of requests that may come up to ten minutes late.

Each micro-batch is screened by the batch operator, together with what earlier
batches left open: the requests of the last ten minutes, whose verdict a late
injection may still change, and the injections that can still flag one of them
or a late request. Both are a table written per batch next to the verdicts, so
an address with a third of the traffic is never one state object or one group
in Python, and a batch that is run again reads the same table and replaces the
same output. A request's verdict is the one of its newest batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.screening import FLAG_SECONDS, flag_counts, flagged_requests
from ..session import path_exists
from .runner import (
    StreamRun, add_changes, change_table, newest_rows, run_available, stream_name, write_batch,
)

LATENESS_SECONDS = 600
OPEN = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("is_injection", T.BooleanType()),
        T.StructField("open", T.BooleanType()),
    ]
)


def _left_open(spark: SparkSession, path: str, batch_id: int, stream: str) -> DataFrame:
    previous = f"{path}/stream={stream}/batch_id={batch_id - 1}"
    if path_exists(spark, previous):
        return spark.read.schema(OPEN).parquet(previous)
    return spark.createDataFrame([], OPEN)


def screen_batch(
    requests: DataFrame, batch_id: int, verdicts: str, state: str, ttl: int = FLAG_SECONDS,
    stream: str = "s0",
) -> None:
    """Write one micro-batch's verdicts, revised ones included, and what it leaves open."""
    columns = [f.name for f in OPEN.fields[:-1]]
    before = _left_open(requests.sparkSession, state, batch_id, stream)
    rows = requests.select(columns).unionByName(before.where("open").select(columns))
    armed = before.where("NOT open").select("client_ip", "ts")
    add_changes(flagged_requests(rows, ttl, armed), batch_id, verdicts, ["query_id"], stream)
    known = rows.withColumn("open", F.lit(True)).unionByName(before.where("NOT open"))
    edge = known.agg(F.max("ts")).scalar() - F.make_dt_interval(secs=F.lit(LATENESS_SECONDS))
    still = F.col("ts") >= edge
    armed_still = F.col("is_injection") & (F.col("ts") > edge - F.make_dt_interval(secs=F.lit(ttl)))
    left = known.where(still | armed_still).withColumn("open", still)
    write_batch(left.select(OPEN.names), state, batch_id, stream=stream)


def stream_ip_flags(
    requests: DataFrame, verdicts: str, state: str, checkpoint: str, ttl: int = FLAG_SECONDS
) -> StreamRun:
    """Verdicts on a stream of requests, see `verdicts_from`."""
    name = stream_name(requests.sparkSession, checkpoint)
    writer = requests.writeStream.foreachBatch(
        lambda df, batch_id: screen_batch(df, batch_id, verdicts, state, ttl, name)
    )
    run = run_available(writer, checkpoint)
    if run.success:
        change_table(requests.sparkSession, verdicts, ["query_id"], name).mark_caught_up()
    return run


def verdicts_from(spark: SparkSession, path: str) -> DataFrame:
    """The verdict of each request so far."""
    return newest_rows(spark, path, ["query_id"])


def flag_counts_from(spark: SparkSession, path: str, ttl: int = FLAG_SECONDS) -> DataFrame:
    """Injections on each address's flag so far, and when it was last armed."""
    return flag_counts(verdicts_from(spark, path), ttl)
