"""The log views the service answers directly: pages, top domains, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import page_of
from ..functions.stats import approx_quantiles, exact_quantiles, value_counts
from ..functions.times import iso_utc


def query_log_page(
    log: DataFrame, domain: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page of the log, newest first; the client address is masked.

    Gathers `offset + limit` rows; `query_log_page_ranged` is for pages far back.
    """
    page = _paged(log, domain).orderBy(*_newest_first()).offset(offset).limit(limit)
    return _served(page)


def query_log_page_ranged(
    log: DataFrame, domain: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """The same page by ranges of the order: only the ranges it lies in are sorted, see `page_of`."""
    return _served(page_of(_paged(log, domain), _newest_first(), offset, limit))


def _paged(log: DataFrame, domain: str | None) -> DataFrame:
    rows = log.where(F.col("recruiter_domain") == domain) if domain else log
    return rows.select("query_id", "request_timestamp", "recruiter_domain", "endpoint_path")


def _newest_first() -> list[Column]:
    return [F.desc("request_timestamp"), F.desc("query_id")]


def _served(page: DataFrame) -> DataFrame:
    return page.select(
        F.col("query_id").alias("id"),
        iso_utc(F.col("request_timestamp")).alias("timestamp"),
        F.col("recruiter_domain").alias("domain"),
        F.col("endpoint_path").alias("path"),
        F.lit("N/A").alias("client_ip"),
    )


def top_domains(log: DataFrame, n: int = 10) -> DataFrame:
    """The n busiest domains, one row each."""
    return (
        log.groupBy(F.col("recruiter_domain").alias("domain"))
        .agg(F.count(F.lit(1)).alias("hits"))
        .orderBy(F.desc("hits"), "domain")
        .limit(n)
    )


def top_domains_map(log: DataFrame, n: int = 10) -> DataFrame:
    """The same as one map; empty for an empty log. Holds n entries at most."""
    pairs = F.collect_list(F.struct("domain", "hits"))
    return top_domains(log, n).agg(F.map_from_entries(pairs).alias("top_domains"))


def latency_percentiles(log: DataFrame, approximate: bool = False) -> DataFrame:
    """p50, p95 and p99 of the response time."""
    probs, value = {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "response_time_ms"
    if approximate:
        return approx_quantiles(log, [], value, probs)
    return exact_quantiles(value_counts(log, [], value), [], value, probs)


def distinct_values(log: DataFrame, column: str | Column, limit: int = 5) -> DataFrame:
    """The first few distinct values of a column."""
    value = F.col(column) if isinstance(column, str) else column
    return log.select(value.alias("value")).distinct().orderBy("value").limit(limit)
