"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores.
Each query is run to the end (all rows of its result are made and discarded),
once to warm up and then BENCH_RUNS times; the best run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from loglattice.functions.times import newest  # noqa: E402
from loglattice.operators import log_reports  # noqa: E402
from loglattice.plans import derived  # noqa: E402
from loglattice.plans.queries import QUERIES  # noqa: E402
from loglattice.session import build_session, scratch_path  # noqa: E402
from loglattice.sources.logs import replicate_rows, write_partitioned  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
COPIES = 50  # 100 000 events become the 5M rows the published numbers are for

BY_NAME = [
    "domain_hits", "top_domain", "domain_scorecard", "endpoint_quantiles",
    "funnel_by_campaign", "funnel_dropoff", "session_depth", "campaign_device_region",
    "latency_percentiles", "flagged_requests", "rate_limit", "cosine_top_k",
    "cosine_top_k_blocked", "chunk_lines", "chunk_words", "anonymize_documents",
    "detect_injection", "read_csv_log",
]


def run_to_end(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(make) -> float:
    times = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        run_to_end(make())
        times.append(time.perf_counter() - start)
    return round(min(times[1:]), 3)


def bytes_under(path: str, days: list[str] | None = None) -> int:
    """Size of the data files, of the given day partitions only if named."""
    total = 0
    for folder, _, names in os.walk(path):
        if days is None or any(f"date={day}" in folder for day in days):
            total += sum(os.path.getsize(os.path.join(folder, n)) for n in names if n.endswith(".parquet"))
    return total


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: best(lambda n=name: QUERIES[n](spark, SF_DIR)) for name in BY_NAME}

    # the 5M-row table, plain and by day
    events = derived.table(spark, SF_DIR, "events").repartition(int(CPUS))
    log = replicate_rows(derived.request_log(events), COPIES)
    plain, by_day = scratch_path(spark, "bench-plain"), scratch_path(spark, "bench-by-day")
    start = time.perf_counter()
    log.write.parquet(plain)
    queries["replicate_rows_5m_write"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    write_partitioned(spark.read.parquet(plain), by_day)
    queries["write_partitioned_5m"] = round(time.perf_counter() - start, 3)
    plain_log, day_log = spark.read.parquet(plain), spark.read.parquet(by_day)
    as_of = newest(plain_log)
    queries["top_domain_5m"] = best(lambda: log_reports.top_domain(plain_log))
    # the events span one month: ten days keep the third that thirty of ninety would
    queries["top_domain_recent_5m_plain"] = best(
        lambda: log_reports.top_domain_recent(plain_log.drop("date"), as_of, days=10))
    queries["top_domain_recent_5m_by_day"] = best(
        lambda: log_reports.top_domain_recent(day_log, as_of, days=10))
    queries["domain_scorecard_5m"] = best(lambda: log_reports.domain_scorecard(plain_log, as_of))
    queries["endpoint_popularity_5m"] = best(
        lambda: log_reports.endpoint_popularity(plain_log, as_of, days=30))
    queries["endpoint_popularity_5m_sketch"] = best(
        lambda: log_reports.endpoint_popularity(plain_log, as_of, days=30, approximate=True))
    queries["session_depth_5m"] = best(lambda: log_reports.session_depth(plain_log, as_of, days=30))

    recent = [str(r["date"]) for r in day_log.where(
        F.col("date") >= F.to_date(F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 10 DAYS"))
    ).select("date").distinct().collect()]
    print(json.dumps({
        "metric": "headline queries, total",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "rows_5m": plain_log.count(),
        "file_bytes": {"plain": bytes_under(plain), "by_day": bytes_under(by_day),
                       "by_day_recent": bytes_under(by_day, recent)},
        "cpus": CPUS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
