"""From raw requests to the warehouse: enrichment, ledger and incremental load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import strip

# scheme, then `//`, then everything up to the path, query or fragment
NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def referer_domain(referer: Column) -> Column:
    """Network location of a referer, port and user included.

    `direct` if there is none; `parsing_error` if its brackets do not pair up.
    """
    cleaned = F.regexp_replace(strip(F.coalesce(referer, F.lit(""))), r"[\t\r\n]", "")
    netloc = F.regexp_extract(cleaned, NETLOC, 1)
    unpaired = F.contains(netloc, F.lit("[")) != F.contains(netloc, F.lit("]"))
    return F.when(netloc == "", "direct").when(unpaired, "parsing_error").otherwise(netloc)


def derive_referer_domain(log: DataFrame, referer: str = "referer_url") -> DataFrame:
    return log.withColumn("recruiter_domain", referer_domain(F.col(referer)))


def enrich_requests(raw: DataFrame) -> DataFrame:
    """Raw requests as live-log rows."""

    def header(name: str) -> Column:
        return F.try_element_at("headers", F.lit(name))

    took = F.round((F.col("finished_at") - F.col("started_at")) * 1000, 2)
    return raw.select(
        "query_id",
        F.col("finished_at").alias("timestamp"),
        "method",
        "path",
        F.coalesce("query_params", F.lit("")).alias("query_params"),
        referer_domain(header("referer")).alias("recruiter_domain"),
        F.coalesce(header("user-agent"), F.lit("")).alias("user_agent"),
        F.coalesce("client_ip", F.lit("")).alias("client_ip"),
        "status_code",
        took.alias("response_time_ms"),
        F.timestamp_seconds(F.floor("finished_at")).alias("created_at"),
        *[header(h).alias(c) for c, h in fv.FUNNEL_HEADERS.items()],
    )


def to_warehouse(log: DataFrame) -> DataFrame:
    """Live-log rows in the warehouse layout."""
    at = F.timestamp_micros(F.round(F.col("timestamp") * 1_000_000).cast("bigint"))
    renamed = log.withColumn("timestamp", at).withColumnsRenamed(
        {
            "timestamp": "request_timestamp",
            "method": "http_method",
            "path": "endpoint_path",
            "status_code": "http_status_code",
        }
    )
    ts = F.col("request_timestamp")
    return renamed.withColumns(
        {
            "hour_of_day": F.hour(ts),
            "day_of_week": F.date_format(ts, "EEEE"),
            "date": F.to_date(ts),
        }
    )


def unsynced_batch(log: DataFrame, ledger: DataFrame, limit: int = 10_000) -> DataFrame:
    """The oldest rows that are not in the ledger yet."""
    return (
        log.join(ledger.select("query_id"), "query_id", "left_anti")
        .orderBy("query_id")
        .limit(limit)
    )


def append_warehouse(batch: DataFrame, path: str) -> int:
    """Append rows by day and return how many were written.

    The count is observed while writing. Days are balanced by size before the
    write, so a hot day becomes several files rather than one task.
    """
    seen = Observation("append_warehouse")
    (
        batch.observe(seen, F.count(F.lit(1)).alias("rows"))
        .hint("rebalance", "date")
        .write.mode("append")
        .partitionBy("date")
        .parquet(path)
    )
    return seen.get["rows"]


def append_ledger(ids: DataFrame, path: str) -> None:
    """Record ids as synced now."""
    ids.select("query_id", F.current_timestamp().alias("synced_at")).write.mode(
        "append"
    ).parquet(path)


def mark_synced(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The log with its synced flag (0/1) set from the given ids."""
    marks = ids.select("query_id").distinct().withColumn("_mark", F.lit(1))
    return log.join(marks, "query_id", "left").select(
        *log.columns, F.coalesce("_mark", F.lit(0)).alias("synced")
    )


def sync_status(log: DataFrame, ledger: DataFrame) -> DataFrame:
    """Total, synced and pending rows."""
    synced = F.count_if(F.col("synced") == 1)
    total = F.count(F.lit(1))
    return mark_synced(log.select("query_id"), ledger).agg(
        total.alias("total"), synced.alias("synced"), (total - synced).alias("pending")
    )
