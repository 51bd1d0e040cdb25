"""Each stream equals its batch twin on the same closed input, in many batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loglattice.operators import log_reports, screening
from loglattice.operators.retrieval import weak_matches
from loglattice.operators.sync import enrich_requests
from loglattice.plans import derived as d
from loglattice.sources.jsonl import read_jsonl_tolerant
from loglattice.streaming import flags, logs, windows

PIECES = 5


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return d.table(spark, sf_dir, "events").cache()


@pytest.fixture(scope="module")
def staged(events, tmp_path_factory):
    """The events as files in time order, to be read one per micro-batch."""
    path = str(tmp_path_factory.mktemp("events"))
    bounds = [i * 1000 // PIECES for i in range(PIECES + 1)]
    for low, high in zip(bounds, bounds[1:]):
        part = events.where(F.col("event_id").between(low, high - 1)).coalesce(1)
        part.write.mode("append").parquet(path)
    return path


@pytest.fixture
def stream(spark, events, staged):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(staged)


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / n) for n in ("out", "checkpoint", "armed")]


def same(a, b):
    columns = sorted(b.columns)
    a, b = a.select(*columns), b.select(*columns)
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_ingest(spark, events, stream, places):
    out, checkpoint, _ = places
    assert logs.stream_log_ingest(d.raw_requests(stream), out, checkpoint).success
    assert same(spark.read.parquet(out), enrich_requests(d.raw_requests(events)))


def test_sync(spark, events, stream, places):
    out, checkpoint, ledger = places
    row = logs.sync_stream(d.live_log(stream), out, ledger, checkpoint).first()
    assert (row["records_fetched"], row["records_loaded"], row["success"]) == (1000, 1000, True)
    table = spark.read.parquet(out)
    assert table.select("batch_id").distinct().count() == PIECES
    assert table.select("query_id").distinct().count() == 1000 == spark.read.parquet(ledger).count()


def test_hourly_traffic(spark, events, stream, places):
    out, checkpoint, _ = places
    run = windows.stream_hourly_traffic(d.request_log(stream), out, checkpoint)
    assert run.success and run.rows_late == 0
    assert same(windows.hourly_traffic_from(spark, out),
                log_reports.hourly_traffic(d.request_log(events), days=10_000))


def test_rate_limit(spark, events, stream, places):
    out, checkpoint, _ = places
    assert windows.stream_rate_limit(d.screened_requests(stream), out, checkpoint, "1 day").success
    verdicts = screening.rate_limit(d.screened_requests(events), limit=2, window="1 day")
    twin = verdicts.groupBy("client_ip", "window_start").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("allowed")).alias("rejected"))
    assert same(windows.rate_limit_from(spark, out, limit=2), twin)


@pytest.mark.parametrize("ttl", [300, 21_600, 200_000])
def test_flags(spark, events, stream, places, ttl):
    out, checkpoint, armed = places
    requests = d.screened_requests(events)
    assert flags.stream_ip_flags(d.screened_requests(stream), out, armed, checkpoint, ttl).success
    verdicts = flags.verdicts_from(spark, out)
    assert same(verdicts, screening.flagged_requests(requests, ttl))
    assert same(flags.flag_counts_from(spark, out, ttl), screening.flag_counts(requests, ttl))


@pytest.mark.parametrize("ttl", [60, 300])
def test_flags_of_late_requests(spark, places, ttl):
    """Requests in batches of shuffled order, none more than ten minutes late."""
    import random

    random.seed(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, random.choice("ab"), start + dt.timedelta(seconds=i * 20), random.random() < 0.08) for i in range(600)]
    rows.append((1000, "a", start + dt.timedelta(seconds=1990), False))
    requests = spark.createDataFrame(rows, "query_id long, client_ip string, ts timestamp, is_injection boolean")
    out, _, state = places
    late = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=random.uniform(0, 590)))
    for batch_id, low in enumerate(range(0, len(late), 40)):
        flags.screen_batch(spark.createDataFrame(late[low : low + 40], requests.schema), batch_id, out, state, ttl)
    want = screening.flagged_requests(requests, ttl)
    assert same(flags.verdicts_from(spark, out), want)
    assert want.where("deflected AND NOT is_injection").count() > 0
    assert same(flags.flag_counts_from(spark, out, ttl), screening.flag_counts(requests, ttl))


def test_flag_batch_run_again_changes_nothing(spark, events, places):
    out, _, armed = places
    requests = d.screened_requests(events)
    for batch_id, part in enumerate((requests.where("query_id < 500"), requests.where("query_id >= 500"))):
        for _ in range(2):
            flags.screen_batch(part, batch_id, out, armed, 200_000)
    assert same(flags.verdicts_from(spark, out), screening.flagged_requests(requests, 200_000))


def test_session_depth(spark, events, stream, places):
    out, checkpoint, _ = places
    assert windows.stream_session_depth(d.request_log(stream), out, checkpoint).success
    assert same(windows.session_depth_from(spark, out),
                log_reports.session_depth(d.request_log(events), days=10_000))


def test_late_rows_are_dropped_and_counted(spark, places, tmp_path):
    out, checkpoint, _ = places
    source = str(tmp_path / "source")
    start = dt.datetime(2024, 1, 1)
    schema = "client_ip string, ts timestamp"

    def feed(*minutes):
        rows = [("a", start + dt.timedelta(minutes=m)) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        return windows.stream_rate_limit(stream, out, checkpoint)

    assert feed(0, 60).rows_late == 0
    assert feed(58).rows_late == 0  # within ten minutes
    assert feed(5).rows_late == 1
    kept = windows.rate_limit_from(spark, out)
    assert kept.agg(F.sum("requests")).first()[0] == 3


def test_weak_matches(spark, places, tmp_path):
    out, checkpoint, _ = places
    source = str(tmp_path / "results")
    results = spark.range(40).select(
        F.concat(F.lit("question "), "id").alias("question"),
        (F.col("id") / 20).alias("top_distance"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("asked_at"),
    )
    results.repartition(4).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(results.schema).option("maxFilesPerTrigger", 1).parquet(source)
        assert logs.stream_weak_matches(stream, out, checkpoint).success
    assert same(read_jsonl_tolerant(spark, out), weak_matches(results, asked_at=F.col("asked_at")))


def test_failures_are_logged_not_raised(spark, events, stream, tmp_path):
    blocked = tmp_path / "file"
    blocked.write_text("not a folder")
    run = logs.append_log_stream(d.live_log(stream), str(blocked / "out"), str(tmp_path / "c"))
    assert run.success is False
    with pytest.raises(RuntimeError):
        run.checked()
