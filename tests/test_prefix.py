"""Running aggregates against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from loglattice.functions.prefix import running


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_equals_a_loop(spark, keys):
    rng = random.Random(4)
    # One key holds a third of the rows, one is NULL; the order has a NULL, so has a value.
    data = [(rng.choice(["hot", "hot", "a", "b", None]), i if i else None, rng.randint(-50, 50) if i % 7 else None) for i in range(600)]
    rng.shuffle(data)
    frame = spark.createDataFrame(data, "k string, i long, v long").repartition(5)
    values = {"n": ("sum", F.lit(1)), "total": ("sum", F.col("v")), "mark": ("xor", F.xxhash64("i")), "most": ("max", F.col("v"))}
    got = running(frame, keys, [F.col("i").asc_nulls_first()], values, parts=7).collect()
    marks = {r["i"]: r["h"] for r in frame.select("i", F.xxhash64("i").alias("h")).collect()}
    want, state = {}, {}
    for k, i, v in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0)):
        n, total, mark, most = state.get(k if keys else 0, (0, None, 0, None))
        if v is not None:
            total, most = (total or 0) + v, v if most is None else max(most, v)
        state[k if keys else 0] = want[i] = (n + 1, total, mark ^ marks[i], most)
    assert {r["i"]: (r["n"], r["total"], r["mark"], r["most"]) for r in got} == want


def test_a_hot_key_is_spread(spark):
    frame = spark.range(4000).select(F.lit(1).alias("k"), "id")
    got = running(frame, ["k"], ["id"], {"n": ("sum", F.lit(1))}, parts=8, part="part").cache()
    assert got.where("n <> id + 1").count() == 0
    sizes = [r["count"] for r in got.groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500


def test_no_rows_and_names_that_clash(spark):
    empty = spark.createDataFrame([], "k string, part long, value0 long")
    assert running(empty, ["k"], ["part"], {"n": ("sum", F.lit(1))}).count() == 0
    one = spark.createDataFrame([("x", 5, 6)], "k string, part long, `odd.name` long")
    assert running(one, [], ["part"], {"n": ("sum", F.col("`odd.name`"))}).collect()[0]["n"] == 6


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_ranks_without_a_key(spark):
    from loglattice.functions.prefix import ranked

    rows = spark.createDataFrame([(i, v) for i, v in enumerate([0.5, None, 0.25, 0.5, None, 1.0, -2.0] * 3)], "i int, v double")
    got = ranked(rows, "v", "rank")
    assert {(r["v"], r["rank"]) for r in got.collect()} == {(1.0, 1), (0.5, 4), (0.25, 10), (-2.0, 13), (None, 16)}
    assert got.count() == 21 and got.columns == ["i", "v", "rank"]


def test_quantiles_and_ranks_meet_in_no_single_task(spark):
    """Only the few totals per range go to one partition, never units, values or sources."""
    from pyspark.sql import Window

    from loglattice.functions.stats import exact_quantiles, value_counts
    from loglattice.operators.log_reports import conversion_by_source

    rows = spark.range(5000).select((F.col("id") % 700 / 7).alias("ms"))
    got = exact_quantiles(value_counts(rows, [], "ms"), [], "ms", {"p50": 0.5, "p95": 0.95, "p100": 1.0})
    want = sorted(r["ms"] for r in rows.collect())
    assert tuple(got.first()) == (want[2499], want[4749], want[4999])
    log = spark.range(300).select(
        F.col("id").cast("string").alias("session_id"), F.concat(F.lit("s"), F.col("id") % 40).alias("traffic_source"),
        F.when(F.col("id") % 3 == 0, "contact").otherwise("impression").alias("funnel_stage"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("request_timestamp"))
    report = conversion_by_source(log, as_of="2024-01-02 00:00:00")
    rate = F.col("conversions") / F.col("total_sessions")
    assert report.where(F.lit(True)).withColumn("want", F.rank().over(Window.orderBy(rate.desc()))).where("want <> source_rank").count() == 0
    for frame, raw in ((got, "_unit"), (report, "traffic_source")):
        lines = plan_of(frame).split("\n")
        for at, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                below = " ".join(lines[at : at + 3])
                assert "part_" in below or "partial_" in below, below


def test_pages_far_back(spark):
    from loglattice.functions.prefix import page_of

    rows = spark.range(1000).select((F.col("id") % 90).alias("a"), "id").repartition(5)
    order = [F.desc("a"), "id"]
    everything = [tuple(r) for r in rows.orderBy(*order).collect()]
    for offset, limit in ((0, 10), (700, 50), (990, 50), (1000, 5), (2000, 5), (123, 400)):
        got = [tuple(r) for r in page_of(rows, order, offset, limit).collect()]
        assert got == everything[offset : offset + limit]
    assert page_of(rows.limit(0), order, 0, 5).count() == 0
