import datetime as dt

import pytest
from pyspark.sql import functions as F

from loglattice.operators.retrieval import weak_matches
from loglattice.schemas import HISTORIC_LOG
from loglattice.plans import derived as d
from loglattice.sources import corpus, jsonl, logs


@pytest.fixture(scope="module")
def log(spark, sf_dir):
    return d.historic_log(d.table(spark, sf_dir, "events"))


def test_csv_round_trip(spark, log, tmp_path):
    path = str(tmp_path / "csv")
    logs.write_csv_log(log, path)
    fixed = logs.read_csv_log(spark, path, infer=False)
    assert fixed.schema.fieldNames() == HISTORIC_LOG.fieldNames()
    assert fixed.exceptAll(log).count() == 0 and fixed.count() == 1000
    detected = logs.read_csv_log(spark, path)
    assert detected.select("timestamp").exceptAll(log.select("timestamp")).count() == 0
    assert dict(detected.dtypes)["response_time_ms"] == "int"


def test_csv_timestamp_as_text(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("query_id,timestamp\n1,2024-01-02 03:04:05\n2,soon\n")
    got = logs.read_csv_log(spark, str(path)).orderBy("query_id").collect()
    assert [r["timestamp"] for r in got] == [dt.datetime(2024, 1, 2, 3, 4, 5), None]


def test_clustered_write_keeps_rows_and_splits_a_hot_day(spark, log, tmp_path):
    log = logs.historic_to_log(log).withColumn(
        "date", F.when(F.col("query_id") % 3 == 0, F.lit(dt.date(2026, 1, 1))).otherwise(F.col("date"))
    )
    path = str(tmp_path / "table")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small data would be merged
    logs.write_partitioned(log, path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = spark.read.parquet(path)
    assert stored.count() == 1000
    hot = stored.where(F.col("date") == "2026-01-01")
    assert hot.select(F.input_file_name()).distinct().count() > 1


def test_replicas(log):
    log = log.limit(50)
    copies = logs.replicate_rows(log, 10)
    assert copies.count() == 500 == copies.select("query_id").distinct().count()
    assert copies.groupBy("recruiter_domain", "timestamp").count().where("count % 10 <> 0").count() == 0


def test_row_counts(spark):
    got = logs.table_row_counts({"a": spark.range(3), "b": spark.range(0)})
    assert {tuple(r) for r in got.collect()} == {("a", 3), ("b", 0)}


def test_weak_match_lines(spark, tmp_path):
    path = str(tmp_path / "weak")
    assert jsonl.read_jsonl_tolerant(spark, path).count() == 0
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    results = spark.createDataFrame(
        [("x" * 600, 0.8), ("close", 0.6), ("border", 0.7), ("far", 0.700049)],
        "question string, top_distance double",
    )
    jsonl.write_jsonl(weak_matches(results, asked_at=at), path)
    jsonl.write_jsonl(weak_matches(results.limit(0), asked_at=at), path)
    got = {r["question"]: r for r in jsonl.read_jsonl_tolerant(spark, path).collect()}
    assert set(got) == {"x" * 300, "far"}
    assert got["far"]["top_distance"] == 0.7 and got["far"]["low_confidence"] is True
    assert got["far"]["ts"] == "2024-01-01T00:00:00+00:00"


def test_corrupt_and_blank_lines_are_skipped(spark, tmp_path):
    path = tmp_path / "u.jsonl"
    good = '{"ts": "t", "question": "%s", "top_distance": 0.9, "low_confidence": true}'
    path.write_text("\n".join([good % "one", "not json{", "", "   ", good % "two"]) + "\n")
    rows = jsonl.read_jsonl_tolerant(spark, str(path))
    assert rows.count() == 2
    assert {r["question"] for r in rows.select("question").collect()} == {"one", "two"}


def test_text_corpus(spark, tmp_path):
    (tmp_path / "a b.txt").write_bytes("line one\nline é\n".encode())
    (tmp_path / "bad.txt").write_bytes(b"caf\xe9 ok")
    (tmp_path / "skip.md").write_text("no")
    got = {r["stem"]: r for r in corpus.read_text_corpus(spark, str(tmp_path)).collect()}
    assert set(got) == {"a b", "bad"}
    assert got["a b"]["text"] == "line one\nline é\n" and got["a b"]["filename"] == "a b.txt"
    assert got["bad"]["text"] == "caf� ok"


def test_weak_matches_of_two_writes_are_searched_once(spark, monkeypatch):
    """Each question's results are made once, although two writes read them."""
    from loglattice.plans import queries

    seen = spark.sparkContext.accumulator(0)

    def tick(distance):
        seen.add(1)
        return distance

    results = spark.range(20).select(
        F.col("id").alias("question_id"), F.lit("q").alias("question"),
        F.udf(tick, "double")(F.lit(0.71) + F.col("id") / 100).alias("top_distance"),
    )
    monkeypatch.setattr(queries, "_results", lambda *_: results)
    monkeypatch.setattr(queries.retrieval, "weak_matches", lambda rows, asked_at: weak_matches(rows, 0.0, asked_at))
    assert queries.write_jsonl(spark, "").count() == 20
    assert seen.value <= 40  # the filter and the columns may each call it
