import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.stats import exact_quantiles, mean, percent, value_counts
from loglattice.operators import log_api, log_reports
from loglattice.schemas import WAREHOUSE
from loglattice.sources.logs import write_partitioned

NOW = dt.datetime(2024, 1, 31, 12, 0, 0)


def log_of(spark, requests):
    """A log from short dicts; unnamed columns are NULL."""
    schema = T.StructType([*WAREHOUSE.fields, T.StructField("skill_searched", T.StringType())])
    names = schema.fieldNames()
    data = []
    for i, r in enumerate(requests):
        r = {"query_id": i, "request_timestamp": NOW, "recruiter_domain": "a.com",
             "endpoint_path": "/resume", "http_status_code": 200, "response_time_ms": 10.0, **r}
        r["date"] = r["request_timestamp"].date()
        data.append(tuple(r.get(n) for n in names))
    return spark.createDataFrame(data, schema)


@pytest.fixture
def seeded(spark):
    ago = lambda s: NOW - dt.timedelta(seconds=s)
    return log_of(spark, [
        {"request_timestamp": ago(300), "recruiter_domain": "google.com", "response_time_ms": 42.0},
        {"request_timestamp": ago(200), "recruiter_domain": "google.com",
         "endpoint_path": "/resume/skills", "response_time_ms": 35.0},
        {"request_timestamp": ago(100), "recruiter_domain": "amazon.com",
         "endpoint_path": "/resume/experience", "response_time_ms": 55.0},
    ])


def test_log_pages(seeded):
    assert log_api.query_log_page(seeded).count() == 3
    assert log_api.query_log_page(seeded, domain="google.com").count() == 2
    first = log_api.query_log_page(seeded, limit=1).first()
    assert first["path"] == "/resume/experience"
    assert first["timestamp"] == "2024-01-31T11:58:20+00:00"
    assert first["client_ip"] == "N/A"
    assert log_api.query_log_page(seeded, limit=1, offset=2).first()["id"] == 0


def test_top_domains(spark, seeded):
    assert log_api.top_domains_map(seeded).first()[0] == {"google.com": 2, "amazon.com": 1}
    assert log_api.top_domains_map(seeded, 1).first()[0] == {"google.com": 2}
    assert log_api.top_domains_map(log_of(spark, []).limit(0)).first()[0] == {}


def test_latency(seeded):
    assert tuple(log_api.latency_percentiles(seeded).first()) == (42.0, 55.0, 55.0)
    assert tuple(log_api.latency_percentiles(seeded, approximate=True).first()) == (42.0, 55.0, 55.0)


def test_exact_quantiles_equal_sorting(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"),
        F.when(F.col("id") % 11 != 0, ((F.col("id") * 7919) % 1013 - 300) / 4.0).alias("v"),
    ).withColumn("k", F.when(F.col("k") != "5", F.col("k")))
    got = {r["k"]: (r["p0"], r["p50"], r["p95"], r["p100"]) for r in exact_quantiles(
        value_counts(df, ["k"], "v"), ["k"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    ).collect()}
    groups = {}
    for r in df.collect():
        if r["v"] is not None:
            groups.setdefault(r["k"], []).append(r["v"])
    assert None in groups
    for key, values in groups.items():
        values.sort()
        want = tuple(values[max(1, -(-len(values) * p // 100)) - 1] for p in (0, 50, 95, 100))
        assert got[key] == want


def test_means_of_any_digits_and_nan(spark):
    """Small values are not cut, and one NaN spoils its own group only."""
    small = spark.createDataFrame([(0.00449,)] * 3 + [(0.00549,)] * 4, "v double")
    assert small.agg(mean(F.col("v"))).first()[0] == 0.01
    assert small.agg(mean(F.col("v"), 6).alias("m")).first()[0] == 0.005061
    log = log_of(spark, [{"response_time_ms": float("nan")}, {"recruiter_domain": "b.com"}, {"recruiter_domain": "b.com"}])
    assert log_reports.domain_rank_first(log).first()["avg_response_ms"] is not None
    counts = value_counts(spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 2.0)], "k string, v double"), ["k"], "v")
    assert tuple(exact_quantiles(counts, ["k"], "v", {"p50": 0.5}).first()) == ("a", 2.0)


def test_mean_and_percent(spark):
    df = spark.createDataFrame([(6.55,), (6.56,), (None,)], "v double")
    assert df.agg(mean(F.col("v"))).first()[0] == 6.56  # 6.555 rounds half up
    one = spark.range(1).select(percent(F.lit(1), F.lit(0), 1), percent(F.lit(1), F.lit(16), 1))
    assert tuple(one.first()) == (None, 6.3)


def test_scorecard(spark):
    day = dt.timedelta(days=1)
    log = log_of(spark, [
        {"skill_searched": "SQL"},
        {"skill_searched": "AWS", "request_timestamp": NOW - 3 * day, "http_status_code": 500},
        {},
        {"recruiter_domain": "b.com"},
        {"recruiter_domain": "b.com", "skill_searched": "React"},
        {"recruiter_domain": "b.com"},
        {"recruiter_domain": "c.com", "response_time_ms": None},
        {"recruiter_domain": "old.com", "request_timestamp": NOW - 100 * day},
    ])
    got = {r["recruiter_domain"]: r.asDict() for r in log_reports.domain_scorecard(log, k=2).collect()}
    assert set(got) == {"a.com", "b.com"}  # tied first; c.com has rank 3, old.com is too old
    assert got["a.com"]["activity_rank"] == got["b.com"]["activity_rank"] == 1
    assert got["a.com"]["top_skill_searched"] == "AWS"  # one each: first name, NULL last
    assert got["b.com"]["top_skill_searched"] is None  # NULL is the most frequent
    assert got["a.com"]["success_rate_pct"] == 66.7
    assert got["a.com"]["engagement_span_days"] == 3
    known = {r["recruiter_domain"]: r for r in
             log_reports.domain_scorecard(log, ignore_null=True).collect()}
    assert known["b.com"]["top_skill_searched"] == "React"
    assert known["c.com"]["top_skill_searched"] is None and known["c.com"]["avg_response_ms"] is None
    assert known["c.com"]["activity_rank"] == 3


def test_ties_share_first_place(spark):
    log = log_of(spark, [{}, {"recruiter_domain": "b.com"}])
    assert log_reports.domain_rank_first(log).count() == 2


def test_skill_search_without_value_is_a_null_group(spark):
    log = log_of(spark, [
        {"endpoint_path": "/resume/skills", "query_params": "keyword=SQL&x=1"},
        {"endpoint_path": "/resume/skills", "query_params": "keyword="},
        {"endpoint_path": "/resume/skills", "query_params": "category=a"},
        {"endpoint_path": "/resume", "query_params": "keyword=SQL"},
    ])
    assert [tuple(r) for r in log_reports.skill_searches(log).collect()] == [("SQL", 1, 1), (None, 1, 1)]


def staged(session, stage, seconds=0, path="/resume", campaign="c1"):
    return {"session_id": session, "funnel_stage": stage, "search_campaign": campaign,
            "traffic_source": "search", "endpoint_path": path,
            "request_timestamp": NOW + dt.timedelta(seconds=seconds)}


def test_funnels(spark):
    log = log_of(spark, [
        staged("s1", "impression"), staged("s1", "engagement", 5, "/a"), staged("s1", "contact", 9.5, "/b"),
        staged("s2", "impression"), staged("s2", "impression"),
        staged("s3", "engagement", campaign="c2"),
        staged(None, "impression"),
        staged("s4", None),
    ])
    campaigns = {r["search_campaign"]: r for r in log_reports.funnel_by_campaign(log).collect()}
    c1, c2 = campaigns["c1"], campaigns["c2"]
    assert (c1["total_sessions"], c1["impressions"], c1["engagements"], c1["contacts"]) == (3, 3, 1, 1)
    assert c1["engagement_rate_pct"] == 33.33
    assert c2["conversion_rate_pct"] is None  # no impression to divide by
    drop = log_reports.funnel_dropoff(log).first()
    assert tuple(drop)[:3] == (2, 2, 1)  # a NULL session is not counted
    assert drop["dropped_after_engagement"] == 1 and drop["overall_conversion_pct"] == 50.0
    depth = {r["search_campaign"]: r for r in log_reports.session_depth(log).collect()}
    assert depth["c1"]["avg_sections_viewed"] == 1.7  # 3, 1 and the NULL session's 1
    assert depth["c1"]["avg_sections_converters"] == 3.0
    assert depth["c1"]["avg_session_duration_sec"] == 3.2  # (9.5 + 0 + 0) / 3
    assert depth["c2"]["avg_sections_converters"] is None
    by_region = log_reports.campaign_device_region(log).collect()
    assert [r["search_campaign"] for r in by_region] == ["c1"]  # c2 has no impressions
    sources = log_reports.conversion_by_source(log).first()
    assert (sources["total_sessions"], sources["conversions"], sources["source_rank"]) == (4, 1, 1)


def test_empty_log(spark):
    log = log_of(spark, [{}]).limit(0)
    assert log_reports.domain_hits(log).count() == 0
    assert log_reports.domain_scorecard(log).count() == 0
    assert log_reports.endpoint_popularity(log).count() == 0
    assert log_reports.log_extent(log).first()["rows"] == 0
    assert tuple(log_reports.funnel_dropoff(log).first())[:4] == (0, 0, 0, None)
    assert log_api.latency_percentiles(log).first()["p50"] is None


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitioned_reports_prune_days(spark, tmp_path):
    day = dt.timedelta(days=1)
    log = log_of(spark, [{"request_timestamp": NOW - i * day} for i in range(40)])
    path = str(tmp_path / "log")
    write_partitioned(log, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 40
    recent = log_reports.top_domain_recent(stored, NOW, days=10)
    assert tuple(recent.first()) == ("a.com", 11)
    (scan,) = [line for line in plan_of(recent).splitlines() if "FileScan" in line]
    assert "PartitionFilters: [isnotnull(date" in scan and ">= 2024-01-21" in scan
    assert "user_agent" not in scan  # columns are pruned


def test_health_reads_the_newest_days_only(spark, tmp_path):
    log = log_of(spark, [{"request_timestamp": NOW - i * dt.timedelta(hours=8)} for i in range(60)])
    path = str(tmp_path / "log")
    write_partitioned(log, path)
    health = log_reports.load_health(spark.read.parquet(path), limit=3)
    assert [(str(r["sync_date"]), r["records"]) for r in health.collect()] == [
        ("2024-01-31", 2), ("2024-01-30", 3), ("2024-01-29", 3)]
    days = plan_of(health).split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "2024-01-31" in days and "2024-01-29" in days and "2024-01-28" not in days


def test_quantile_reports_scan_once(spark, tmp_path):
    path = str(tmp_path / "log")
    log_of(spark, [{"response_time_ms": float(i)} for i in range(100)]).write.parquet(path)
    report = log_reports.endpoint_popularity(spark.read.parquet(path), NOW)
    assert report.collect()[0]["p95_latency_ms"] == 94.0
    assert "ReusedExchange" in plan_of(report)


def test_top_k_is_cut_before_the_shuffle(spark, seeded):
    plan = plan_of(log_reports.domain_scorecard(seeded))
    assert plan.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan_of(log_api.query_log_page(seeded))


def test_reports_prune_days_without_an_instant(spark, tmp_path):
    """The default looks back from the newest row, found in the newest day's partition only."""
    path = str(tmp_path / "by_day")
    rows = [{"request_timestamp": NOW - dt.timedelta(days=i)} for i in range(0, 120, 5)]
    log_of(spark, rows).withColumn("date", F.to_date("request_timestamp")).write.partitionBy("date").parquet(path)
    log = spark.read.parquet(path)
    for report in (log_reports.domain_scorecard, log_reports.hourly_traffic, log_reports.recent_top_domains):
        plan = report(log)._jdf.queryExecution().executedPlan().toString()
        filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
        assert filters and all("date" in line.split("PartitionFilters: [")[1].split("]")[0] for line in filters)
    assert log_reports.load_health(log, 3).count() == 3
