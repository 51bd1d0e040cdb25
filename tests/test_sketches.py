"""Daily summaries against exact figures on skewed logs, beyond the sizes they are exact for."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loglattice.operators import log_sketches as ls

SCHEMA = (
    "request_timestamp timestamp, recruiter_domain string, endpoint_path string, response_time_ms double, "
    "session_id string, search_campaign string, traffic_source string, funnel_stage string, skill_searched string"
)
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    rng, rows = random.Random(6), []
    for i in range(12_000):
        domain = rng.choice(["hot.com", "hot.com", "a.com", "b.com", None])
        rows.append((
            START + dt.timedelta(minutes=rng.randrange(10 * 1440)), domain, rng.choice(["/x", "/y"]),
            rng.choice([None, rng.expovariate(0.01), 40.0]), rng.choice([None, f"s{rng.randrange(5000)}"]),
            rng.choice(["c1", "c2", None]), rng.choice(["s1", None]),
            rng.choice(["impression", "impression", "impression", "engagement", "contact", None]),
            rng.choice([None, "sql", f"rare{rng.randrange(400)}", f"skill{int(rng.paretovariate(1.1)) % 50}"]),
        ))
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("date", F.to_date("request_timestamp"))
    return frame.repartition(6).cache()


def stored(spark, summary, tmp_path):
    path = str(tmp_path / "daily")
    ls.write_daily(summary, path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("lg", [8, 12])
def test_drop_off_keeps_its_bound(spark, log, tmp_path, lg):
    sketches = stored(spark, ls.funnel_sketches(log, lg), tmp_path)
    got = ls.funnel_dropoff_from(sketches, days=8, lg=lg).first()
    reached = {}
    for r in ls.last_days(log, None, 8).where("funnel_stage IS NOT NULL AND session_id IS NOT NULL").collect():
        reached.setdefault(r["session_id"], set()).add(r["funnel_stage"])
    i, e, c = ({s for s, on in reached.items() if stage in on} for stage in ls.STAGES)
    want = {
        "sessions": len(reached), "step_1_impressions": len(i), "step_2_engagements": len(e), "step_3_contacts": len(c),
        "engaged": len(i & e), "completed": len(i & e & c), "lost_after_impression": len(i - e),
        "lost_after_engagement": len((i & e) - c),
    }
    assert want["completed"] > 20 and want["sessions"] > 3 << 8
    margin = 0 if lg == 12 else got["error"] * len(reached)
    for name, exact in want.items():
        assert abs(got[name] - exact) <= margin, name


def test_campaigns_and_no_rows(spark, log, tmp_path):
    sketches = stored(spark, ls.funnel_sketches(log), tmp_path)
    got = {r["search_campaign"]: r for r in ls.funnel_by_campaign_from(sketches, days=3).collect()}
    assert set(got) == {"c1", "c2", None}
    visits = ls.last_days(log, None, 3).where("funnel_stage IS NOT NULL").select("search_campaign", "session_id", "traffic_source").distinct()
    for r in visits.groupBy("search_campaign").count().collect():
        assert got[r["search_campaign"]]["total_sessions"] == r["count"]
    assert ls.funnel_by_campaign_from(ls.funnel_sketches(log.limit(0))).count() == 0
    nothing = ls.funnel_dropoff_from(ls.funnel_sketches(log.limit(0))).first()
    assert nothing["sessions"] == nothing["engaged"] == 0 and nothing["engaged_pct"] is None


@pytest.mark.parametrize("k", [50, 1000])
def test_quantiles_keep_their_rank_error(spark, log, tmp_path, k):
    keys, probs = ["recruiter_domain", "endpoint_path"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    sketches = stored(spark, ls.latency_sketches(log, k), tmp_path)
    for by in (keys, []):
        got = ls.latency_quantiles_from(sketches, by, probs, k)
        assert got.agg(F.sum("hits")).first()[0] == 12_000
        for r in ls.rank_shares(log, got, by, "response_time_ms", list(probs)).collect():
            for name, p in probs.items():
                assert r[f"{name}_below"] <= p + ls.kll_error(k) and r[f"{name}_upto"] >= p - ls.kll_error(k)


def test_reports_read_sketches_only(spark, log, tmp_path):
    sketches = stored(spark, ls.latency_sketches(log), tmp_path)
    plan = ls.endpoint_popularity_from(sketches, as_of="2024-01-10", days=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == plan.count("FileScan") and "PartitionFilters: [isnotnull(date" in plan
    nothing = sketches.withColumn("n_ms", F.lit(0).cast("long"))
    assert ls.latency_percentiles_from(nothing).first()["p50"] is None
    again = ls.latency_sketches(log.where("date = '2024-01-02'").limit(3))
    ls.write_daily(again, str(tmp_path / "daily"))  # a day written again replaces itself
    assert spark.read.parquet(str(tmp_path / "daily")).where("date = '2024-01-02'").agg(F.sum("hits")).first()[0] == 3


@pytest.mark.parametrize("kept", [1, 5, 64])
def test_frequent_items(spark, log, tmp_path, kept):
    daily = stored(spark, ls.frequent_items(log, ["date", "recruiter_domain"], "skill_searched", kept), tmp_path)
    merged = {r["recruiter_domain"]: r for r in ls.merge_frequent(daily, ["recruiter_domain"], kept).collect()}
    exact = {}
    for r in log.groupBy("recruiter_domain", "skill_searched").count().collect():
        exact.setdefault(r["recruiter_domain"], {})[r["skill_searched"]] = r["count"]
    assert set(merged) == set(exact)
    for domain, counts in exact.items():
        m, n = merged[domain], sum(counts.values())
        assert m["n"] == n and m["missing"] <= n / (kept + 1) and len(m["items"]) <= kept
        listed = {x["item"]: x["at_least"] for x in m["items"]}
        for item, count in counts.items():
            assert listed.get(item, 0) <= count <= listed.get(item, 0) + m["missing"]
            assert item in listed or count <= n / (kept + 1)
    top = ls.top_items(ls.merge_frequent(daily, ["recruiter_domain"], kept), ["recruiter_domain"], 1).collect()
    for r in top:
        counts = exact[r["recruiter_domain"]]
        assert r["at_least"] <= counts[r["item"]] <= r["at_most"] and (kept < 64 or counts[r["item"]] == max(counts.values()))
    assert ls.merge_frequent(ls.frequent_items(log.limit(0), ["date"], "skill_searched"), ["date"]).count() == 0
