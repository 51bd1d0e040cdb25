import datetime as dt

import pytest
from pyspark.sql import functions as F

from loglattice.operators import sync
from loglattice.schemas import LIVE_LOG, RAW_REQUEST
from loglattice.streaming import logs as streams

START = dt.datetime(2024, 1, 31, 23, 30, tzinfo=dt.timezone.utc).timestamp()


def live(spark, ids, step=600.0):
    rows = [(i, START + i * step, "GET", "/resume", "", "a.com", "ua", "1.2.3.4", 200, 5.0,
             dt.datetime(2024, 1, 31), *[None] * 6) for i in ids]
    return spark.createDataFrame(rows, LIVE_LOG)


@pytest.mark.parametrize("referer, domain", [
    (None, "direct"), ("", "direct"), ("https://a.com/careers", "a.com"),
    ("https://a.com:8080/x", "a.com:8080"), ("/relative", "direct"), ("a.com/x", "direct"),
    ("//b.org?q", "b.org"), ("https://u:p@host:1/x", "u:p@host:1"), ("https://[::1/x", "parsing_error"),
    ("https://[::1]:80/x", "[::1]:80"), ("https://a b.com/x", "a b.com"), (" https://a.com", "a.com"),
])
def test_referer(spark, referer, domain):
    df = spark.createDataFrame([(referer,)], "referer_url string")
    assert sync.derive_referer_domain(df).first()["recruiter_domain"] == domain


def test_enrich(spark):
    raw = spark.createDataFrame([
        (1, 100.0, 100.0425678, "GET", "/resume", None,
         {"referer": "https://a.com/x", "x-session-id": "s1", "x-funnel-stage": "contact"}, None, 404),
        (2, 100.0, 101.5, "POST", "/x", "a=1", {}, "9.9.9.9", 200),
    ], RAW_REQUEST)
    one, two = sync.enrich_requests(raw).orderBy("query_id").collect()
    assert (one["timestamp"], one["response_time_ms"]) == (100.0425678, 42.57)
    assert (one["query_params"], one["user_agent"], one["client_ip"]) == ("", "", "")
    assert (one["recruiter_domain"], one["session_id"], one["funnel_stage"]) == ("a.com", "s1", "contact")
    assert one["geo_region"] is None and two["recruiter_domain"] == "direct"


def test_warehouse_columns(spark):
    row = sync.to_warehouse(live(spark, [0])).first()
    assert row["request_timestamp"] == dt.datetime(2024, 1, 31, 23, 30)
    assert (row["hour_of_day"], row["day_of_week"], row["date"]) == (23, "Wednesday", dt.date(2024, 1, 31))
    assert {"http_method", "endpoint_path", "http_status_code"} <= set(row.asDict())


def test_ledger(spark, tmp_path):
    log, path = live(spark, range(10)), str(tmp_path / "ledger")
    sync.append_ledger(log.where("query_id < 4"), path)
    ledger = spark.read.parquet(path)
    batch = sync.unsynced_batch(log, ledger, limit=3)
    assert [r["query_id"] for r in batch.collect()] == [4, 5, 6]
    sync.append_ledger(batch, path)
    ledger = spark.read.parquet(path)
    assert tuple(sync.sync_status(log, ledger).first()) == (10, 7, 3)
    marked = sync.mark_synced(log, ledger.union(ledger))  # marking twice is marking once
    assert marked.count() == 10 and marked.agg(F.sum("synced")).first()[0] == 7


def test_append_counts_and_never_truncates(spark, tmp_path):
    path = str(tmp_path / "wh")
    assert sync.append_warehouse(sync.to_warehouse(live(spark, range(5))), path) == 5
    assert sync.append_warehouse(sync.to_warehouse(live(spark, range(5, 7))), path) == 2
    assert spark.read.parquet(path).count() == 7


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / n) for n in ("source", "warehouse", "ledger", "checkpoint")]


def ids(spark, path):
    return sorted(r["query_id"] for r in spark.read.parquet(path).select("query_id").collect())


def test_sync_twice_loads_once(spark, places):
    source, warehouse, ledger, checkpoint = places
    live(spark, range(20)).repartition(4).write.parquet(source)
    first = streams.run_sync(spark, *places, max_files=1).first()
    assert (first["records_fetched"], first["records_loaded"], first["success"]) == (20, 20, True)
    second = streams.run_sync(spark, *places).first()
    assert (second["records_fetched"], second["records_loaded"]) == (0, 0)
    live(spark, range(20, 25)).write.mode("append").parquet(source)
    third = streams.run_sync(spark, *places).first()
    assert (third["records_fetched"], third["records_loaded"]) == (5, 5)
    assert ids(spark, warehouse) == ids(spark, ledger) == list(range(25))


def test_sync_after_a_crash_between_load_and_mark(spark, places, monkeypatch):
    source, warehouse, ledger, checkpoint = places
    live(spark, range(10)).write.parquet(source)
    write = streams.write_batch

    def crash_on_ledger(df, path, *rest):
        if path == ledger:
            raise RuntimeError("executor lost")
        write(df, path, *rest)

    monkeypatch.setattr(streams, "write_batch", crash_on_ledger)
    assert streams.run_sync(spark, *places).first()["success"] is False
    assert ids(spark, warehouse) == list(range(10))  # loaded, not marked
    monkeypatch.setattr(streams, "write_batch", write)
    assert streams.run_sync(spark, *places).first()["success"] is True
    assert ids(spark, warehouse) == ids(spark, ledger) == list(range(10))


def test_sync_with_a_lost_checkpoint_and_repeated_rows(spark, places, tmp_path):
    source, warehouse, ledger, checkpoint = places
    live(spark, [0, 1, 2]).union(live(spark, [2])).write.parquet(source)
    streams.run_sync(spark, *places)
    assert ids(spark, warehouse) == [0, 1, 2]
    live(spark, [3]).write.mode("append").parquet(source)
    streams.run_sync(spark, *places)
    streams.run_sync(spark, source, warehouse, ledger, str(tmp_path / "new"))
    assert ids(spark, warehouse) == [0, 1, 2, 3]


def test_two_checkpoints_into_one_warehouse(spark, tmp_path):
    """Batch ids start anew with each checkpoint; no row of another stream is replaced."""
    at = {n: str(tmp_path / n) for n in ("one", "two", "warehouse", "ledger", "c1", "c2")}
    live(spark, [0, 2, 4]).write.parquet(at["one"])
    live(spark, [1, 3, 5]).write.parquet(at["two"])
    for source, checkpoint in (("one", "c1"), ("two", "c2"), ("one", "c1")):
        streams.run_sync(spark, at[source], at["warehouse"], at["ledger"], at[checkpoint])
    assert ids(spark, at["warehouse"]) == ids(spark, at["ledger"]) == list(range(6))


def test_lost_checkpoint_with_a_trimmed_source(spark, places, tmp_path):
    source, warehouse, ledger, checkpoint = places
    live(spark, [0, 1, 2]).write.parquet(source)
    streams.run_sync(spark, *places)
    trimmed = str(tmp_path / "trimmed")
    live(spark, [2, 3]).write.parquet(trimmed)
    streams.run_sync(spark, trimmed, warehouse, ledger, str(tmp_path / "new"))
    assert ids(spark, warehouse) == ids(spark, ledger) == [0, 1, 2, 3]


def test_an_id_sent_again_on_another_day_loads_once(spark, places):
    source, warehouse, ledger, checkpoint = places
    rows = live(spark, [0, 1, 2])
    rows.write.parquet(source)
    streams.run_sync(spark, *places)
    again = rows.withColumn("timestamp", F.col("timestamp") + 5 * 86_400)
    again.union(live(spark, [7])).union(live(spark, [7]).withColumn("timestamp", F.col("timestamp") - 86_400)).write.mode("append").parquet(source)
    streams.run_sync(spark, *places)
    assert ids(spark, warehouse) == [0, 1, 2, 7]
    kept = spark.read.parquet(warehouse).where("query_id = 7").first()["request_timestamp"]
    want = sync.to_warehouse(live(spark, [7])).first()["request_timestamp"] - dt.timedelta(days=1)
    assert kept == want


def test_stream_failure_is_reported_not_raised(spark, tmp_path):
    bad = streams.run_sync(spark, str(tmp_path / "missing"), *[str(tmp_path / n) for n in "abc"])
    assert bad.first()["success"] is False and bad.first()["records_loaded"] == 0
