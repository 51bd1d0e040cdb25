"""Committed tables: crashes at any step, streams apart, reading that does not grow, lost checkpoints."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loglattice.session import list_names, read_text, write_new
from loglattice.streaming import committed, flags, runner, windows
from loglattice.streaming.committed import Tables, newest_of

KEYS = ["k"]


def batch(spark, n, size=5):
    """Key 0 to size-1, each with the batch's number as its value."""
    return spark.range(size).select(F.col("id").alias("k"), F.lit(n).alias("v"), F.lit(n).cast("bigint").alias("batch_id"))


def tables(spark, path):
    return Tables(spark, str(path), {"changes": newest_of(KEYS), "all": None}, {"all": ["v"]})


def add(t, n, stream="a", size=5):
    rows = batch(t.spark, n, size)
    return t.commit(stream, n, lambda _: {"changes": lambda _: rows, "all": lambda done: done["changes"]})


def content(t, table="changes"):
    return sorted((r["k"], r["v"]) for r in t.read(table).collect())


def test_newest_wins_and_reading_does_not_grow(spark, tmp_path):
    t = tables(spark, tmp_path)
    assert t.read("changes") is None
    for n in range(50):
        add(t, n)
        assert max(len(runs) for runs in t.state().runs.values()) <= 2 * committed.FAN_IN
    assert content(t) == [(k, 49) for k in range(5)]
    assert content(t, "all") == sorted((k, n) for k in range(5) for n in range(50))
    assert t.read("all").where("v = 7").count() == 5
    # What is read: a few folders per level, whatever the number of batches.
    assert len(t.read("changes").inputFiles()) < 20
    assert len(list_names(spark, f"{tmp_path}/_manifests")) <= committed.KEPT
    # What was merged long ago is gone from disk.
    assert len(list_names(spark, f"{tmp_path}/changes")) < 50


def test_a_batch_that_comes_again_is_there_already(spark, tmp_path):
    t = tables(spark, tmp_path)
    for n in (0, 1, 1, 0):
        add(t, n)
    assert content(t) == [(k, 1) for k in range(5)] and t.read("all").count() == 10


@pytest.mark.parametrize("step", ["write", "second write", "publish", "compact", "publish compacted"])
def test_a_crash_at_any_step(spark, tmp_path, monkeypatch, step):
    t = tables(spark, tmp_path)
    for n in range(committed.FAN_IN - 1):
        add(t, n)
    write, publish, seen = Tables._write, Tables._publish, []

    def crash(*_):
        raise RuntimeError("driver lost")

    def failing_write(self, table, rows, level=0):
        if step == "write" or (step == "second write" and table == "all" and not level) or (step == "compact" and level):
            crash()
        return write(self, table, rows, level)

    def failing_publish(self, state):
        seen.append(state)
        if step == "publish" or (step == "publish compacted" and len(seen) > 1):
            crash()
        return publish(self, state)

    monkeypatch.setattr(Tables, "_write", failing_write)
    monkeypatch.setattr(Tables, "_publish", failing_publish)
    last = committed.FAN_IN - 1
    with pytest.raises(RuntimeError):
        add(t, last)
    monkeypatch.undo()
    done = step in ("compact", "publish compacted")
    assert content(t) == [(k, last - (not done)) for k in range(5)]
    assert t.read("all").count() == 5 * (last + done)
    for n in (last, last + 1):
        add(t, n)
    assert content(t) == [(k, last + 1) for k in range(5)]
    assert t.read("all").count() == 5 * (last + 2)


def test_two_streams_that_publish_at_once(spark, tmp_path, monkeypatch):
    one, two = tables(spark, tmp_path), tables(spark, tmp_path)
    built = []

    def build(state):
        built.append(state.version)
        if len(built) == 1:
            add(two, 0, "b")  # the other stream is faster
        return {"changes": lambda _: batch(spark, 5), "all": lambda done: done["changes"]}

    one.commit("a", 0, build)
    assert built == [0, 1]
    assert one.read("all").count() == 10 and one.state().done == {"a": 0, "b": 0}


def test_a_file_is_written_once(spark, tmp_path):
    path = str(tmp_path / "file")
    assert write_new(spark, path, "é") and not write_new(spark, path, "b")
    assert read_text(spark, path) == "é" and list_names(spark, str(tmp_path)) == ["file"]


START = dt.datetime(2024, 1, 1)


def requests(spark, ids):
    rows = [(i, f"ip{i % 3}", START + dt.timedelta(minutes=i), 10.0 + i, f"s{i % 7}", "c", "impression", "/x", i % 5 == 0) for i in ids]
    return spark.createDataFrame(
        rows,
        "query_id long, client_ip string, ts timestamp, response_time_ms double, session_id string, "
        "search_campaign string, funnel_stage string, endpoint_path string, is_injection boolean",
    ).withColumn("request_timestamp", F.col("ts"))


RUNS = {
    "hourly": (lambda s, out, state: windows.stream_hourly_traffic(s, out, state), lambda spark, out: windows.hourly_traffic_from(spark, out), "requests"),
    "rate": (lambda s, out, state: windows.stream_rate_limit(s, out, state), lambda spark, out: windows.rate_limit_from(spark, out), "requests"),
    "depth": (lambda s, out, state: windows.stream_session_depth(s, out, state), lambda spark, out: windows.session_depth_from(spark, out), None),
    "flags": (lambda s, out, state: flags.stream_ip_flags(s, out, f"{out}-open", state), lambda spark, out: flags.verdicts_from(spark, out), None),
}


@pytest.mark.parametrize("name", RUNS)
def test_after_a_lost_checkpoint(spark, tmp_path, name):
    """Three batches under one checkpoint, then one batch over everything under another: equal to a fresh run."""
    run, report, total = RUNS[name]
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    schema = requests(spark, [0]).schema

    def go(checkpoint, to=out):
        return run(spark.readStream.schema(schema).parquet(source), to, str(tmp_path / checkpoint))

    for low in (0, 10, 20):
        requests(spark, range(low, low + 10)).coalesce(1).write.mode("append").parquet(source)
        assert go("first").success
    if total:
        assert report(spark, out).agg(F.sum(total)).first()[0] == 30
    requests(spark, range(30, 80)).coalesce(1).write.mode("append").parquet(source)
    assert go("second").success and go("third", f"{out}-fresh").success
    got, want = report(spark, out), report(spark, f"{out}-fresh")
    if total:
        assert got.agg(F.sum(total)).first()[0] == 80
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_a_stream_that_has_not_caught_up_does_not_count_yet(spark, tmp_path):
    path = str(tmp_path)
    for stream, n in (("s1", 3), ("s2", 1)):
        runner.add_changes(spark.range(n).select(F.col("id").alias("k")), 0, path, KEYS, stream)
    assert runner.newest_rows(spark, path, KEYS).count() == 1  # none has: the newest
    runner.change_table(spark, path, KEYS, "s1").mark_caught_up()
    assert runner.newest_rows(spark, path, KEYS).count() == 3
    runner.change_table(spark, path, KEYS, "s2").mark_caught_up()
    assert runner.newest_rows(spark, path, KEYS).count() == 1
    with pytest.raises(FileNotFoundError):
        runner.newest_rows(spark, f"{path}/none", KEYS)
