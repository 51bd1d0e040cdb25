"""`as_of` handling: reports look back from a given instant, not the wall clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of_column(log: DataFrame, as_of, ts: str = "request_timestamp") -> Column:
    """The given instant as a literal; without one, the newest row of the log."""
    if as_of is None:
        as_of = newest(log, ts)
    if as_of is None or isinstance(as_of, (dt.datetime, str)):
        return F.lit(as_of).cast("timestamp")
    return as_of


def newest(log: DataFrame, ts: str = "request_timestamp") -> str | None:
    """The newest instant as text in the session's zone (one row reaches the driver).

    A literal bound prunes partitions when the query is planned; a subquery does
    not. On a log with a `date` column only its newest day is read for the time.
    """
    if "date" in log.columns:
        # Cast to text and back: a date from Python would go through the driver's zone.
        day = log.agg(F.max("date").cast("string").alias("d")).first()["d"]
        if day is not None:
            log = log.where(F.col("date") == F.lit(day).cast("date"))
    return log.agg(F.max(ts).cast("string").alias("t")).first()["t"]


def back(as_of: Column, *, days: int = 0, hours: int = 0) -> Column:
    return as_of - F.expr(f"INTERVAL {days * 24 + hours} HOURS")


def since(log: DataFrame, as_of, *, days: int = 0, hours: int = 0,
          ts: str = "request_timestamp") -> DataFrame:
    """Rows no older than the given span.

    The bound is repeated on the stored `date` column, because a predicate on
    the timestamp alone does not prune partitions.
    """
    start = back(as_of_column(log, as_of, ts), days=days, hours=hours)
    kept = log.where(F.col(ts) >= start)
    if "date" in log.columns:
        kept = kept.where(F.col("date") >= F.to_date(start))
    return kept


def iso_utc(ts: Column) -> Column:
    """ISO 8601 in UTC; the fraction only if there is one."""
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    fraction = F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros))
    return F.concat(seconds, fraction, F.lit("+00:00"))
