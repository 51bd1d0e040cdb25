"""Daily summaries of the request log, small and mergeable, and the reports that read them instead of the log.

A day's summary is made once; a report over any days merges the stored rows and never scans the log. Three kinds:
theta sketches of sessions per funnel stage (unions, intersections, differences), KLL sketches of latencies, and
frequent items with bounds. Reports over sketches count whole days: the last `days` of them up to the newest
one stored, or up to `as_of`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import mean_of, percent

#: 2^12 hashes a sketch: the counts are exact up to that many sessions.
LG_SESSIONS = 12
#: Size of a latency sketch.
K_LATENCY = 1000
#: Items kept per key and day.
ITEMS = 64
#: Parts an item count is first cut down in, so that one key's items never meet in one task.
SLICES = 16

STAGES = ("impression", "engagement", "contact")


def theta_error(lg: int = LG_SESSIONS) -> float:
    """Three standard errors of a count, as a share of it; of an intersection or difference, as a share of the union."""
    return 3 / 2 ** (lg / 2)


def kll_error(k: int = K_LATENCY) -> float:
    """Published bound of a KLL sketch's rank error at 99 %, as a share of the values."""
    return 2.296 / k**0.9021


def items_error(n: Column, kept: int = ITEMS) -> Column:
    """At most this much is missing from a count of frequent items, of n in all."""
    return n / (kept + 1)


def _day(log: DataFrame) -> Column:
    return F.col("date") if "date" in log.columns else F.to_date("request_timestamp")


def write_daily(summary: DataFrame, path: str) -> None:
    """Store summaries by day; a day written again replaces itself."""
    (
        summary.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("date").parquet(path)
    )


def last_days(summary: DataFrame, as_of: str | None, days: int) -> DataFrame:
    """Rows of the last whole days. The bound is a literal, so that other days are not read."""
    newest = F.lit(as_of) if as_of else F.lit(summary.agg(F.max("date").cast("string")).first()[0])
    end = F.to_date(newest)
    return summary.where((F.col("date") > F.date_sub(end, days)) & (F.col("date") <= end))


# -- sessions: theta sketches --------------------------------------------------


def funnel_sketches(log: DataFrame, lg: int = LG_SESSIONS) -> DataFrame:
    """(date, search_campaign, funnel_stage, sessions, visits, events) of rows that have a stage.

    `sessions` is a sketch of session ids, `visits` one of (session, traffic source) pairs. NULL sessions are in no
    `sessions`, as in a distinct count; as part of a visit NULL is a value.
    """
    staged = log.where(F.col("funnel_stage").isNotNull())
    visit = F.xxhash64(F.lit(1), "session_id", F.lit(2), "traffic_source")
    return staged.groupBy(_day(log).alias("date"), "search_campaign", "funnel_stage").agg(
        F.theta_sketch_agg("session_id", lg).alias("sessions"),
        F.theta_sketch_agg(visit, lg).alias("visits"),
        F.count(F.lit(1)).alias("events"),
    )


def _stages(sketches: DataFrame, column: str, keys: Sequence[str], lg: int) -> DataFrame:
    """Per key a merged sketch of each stage, and of all stages."""
    of_stage = [
        F.theta_union_agg(F.when(F.col("funnel_stage") == s, F.col(column)), lg).alias(s) for s in STAGES
    ]
    return sketches.groupBy(*keys).agg(*of_stage, F.theta_union_agg(column, lg).alias("all_stages"))


def _size(sketch: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("long")


def funnel_dropoff_from(
    sketches: DataFrame, as_of: str | None = None, days: int = 7, lg: int = LG_SESSIONS
) -> DataFrame:
    """Sessions per stage and the sessions that went from stage to stage, from `funnel_sketches`.

    Besides the counts of each stage: `engaged` sessions had an impression and an engagement, `completed` ones all
    three stages, `lost_after_impression` an impression and no engagement, `lost_after_engagement` both and no
    contact. `error` is the stated bound: a share of the count for the stages, of `sessions` for the others.
    """
    one, two, three = (F.col(s) for s in STAGES)
    both = F.theta_intersection(one, two)
    merged = _stages(last_days(sketches, as_of, days), "sessions", [], lg)
    counts = merged.select(
        _size(F.col("all_stages")).alias("sessions"),
        _size(one).alias("step_1_impressions"),
        _size(two).alias("step_2_engagements"),
        _size(three).alias("step_3_contacts"),
        _size(both).alias("engaged"),
        _size(F.theta_intersection(both, three)).alias("completed"),
        _size(F.theta_difference(one, two)).alias("lost_after_impression"),
        _size(F.theta_difference(both, three)).alias("lost_after_engagement"),
    )
    return counts.withColumns(
        {
            "engaged_pct": percent(F.col("engaged"), F.col("step_1_impressions"), 1),
            "completed_pct": percent(F.col("completed"), F.col("step_1_impressions"), 1),
            "error": F.lit(theta_error(lg)),
        }
    )


def funnel_by_campaign_from(
    sketches: DataFrame, as_of: str | None = None, days: int = 7, lg: int = LG_SESSIONS
) -> DataFrame:
    """Visits per campaign and stage with their rates, from `funnel_sketches`; the columns of `funnel_by_campaign`."""
    merged = _stages(last_days(sketches, as_of, days), "visits", ["search_campaign"], lg)
    counts = merged.select(
        "search_campaign",
        _size(F.col("all_stages")).alias("total_sessions"),
        *[_size(F.col(s)).alias(f"{s}s") for s in STAGES],
    )
    return counts.withColumns(
        {
            "engagement_rate_pct": percent(F.col("engagements"), F.col("impressions"), 2),
            "conversion_rate_pct": percent(F.col("contacts"), F.col("impressions"), 2),
        }
    ).orderBy(F.desc("total_sessions"), "search_campaign")


# -- latencies: KLL sketches ---------------------------------------------------


def latency_sketches(log: DataFrame, k: int = K_LATENCY) -> DataFrame:
    """(date, recruiter_domain, endpoint_path, hits, ms, n_ms, latency): counts, sum and a sketch of latencies.

    NULL latencies are hits without a latency.
    """
    value = F.col("response_time_ms").cast("double")
    return log.groupBy(_day(log).alias("date"), "recruiter_domain", "endpoint_path").agg(
        F.count(F.lit(1)).alias("hits"),
        F.sum(value).alias("ms"),
        F.count(value).alias("n_ms"),
        F.kll_sketch_agg_double(value, k).alias("latency"),
    )


def latency_quantiles_from(
    sketches: DataFrame, keys: Sequence[str], probs: dict[str, float], k: int = K_LATENCY
) -> DataFrame:
    """Hits, mean latency and latency quantiles per key from `latency_sketches` of any days.

    A quantile's rank is off by `kll_error(k)` at most, but for one case in a hundred. NULL for a key without latencies.
    """
    some = F.when(F.col("n_ms") > 0, F.col("latency"))
    merged = sketches.groupBy(*keys).agg(
        F.sum("hits").alias("hits"),
        mean_of(F.sum("ms"), F.sum("n_ms")).alias("avg_latency_ms"),
        F.sum("n_ms").alias("_n"),
        F.kll_merge_agg_double(some, k).alias("_s"),
    )
    quantiles = [
        F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_s", F.lit(p))).alias(name) for name, p in probs.items()
    ]
    return merged.select(*keys, "hits", "avg_latency_ms", *quantiles)


def endpoint_quantiles_from(
    sketches: DataFrame,
    as_of: str | None = None,
    domains: Sequence[str] = ("google.com", "amazon.com"),
    from_days: int = 60,
    to_days: int = 30,
) -> DataFrame:
    """Hits, p95 and p50 per domain and endpoint between two days, inclusive; as `endpoint_quantiles`."""
    newest = as_of or sketches.agg(F.max("date").cast("string")).first()[0]
    end = F.to_date(F.lit(newest))
    some = sketches.where(
        F.col("date").between(F.date_sub(end, from_days), F.date_sub(end, to_days)) & F.col("recruiter_domain").isin(list(domains))
    )
    keys = ["recruiter_domain", "endpoint_path"]
    probs = {"p95_response_ms": 0.95, "p50_response_ms": 0.5}
    return latency_quantiles_from(some, keys, probs).drop("avg_latency_ms").orderBy(F.desc("hits"), *keys)


def endpoint_popularity_from(sketches: DataFrame, as_of: str | None = None, days: int = 7) -> DataFrame:
    """Hits, mean and p95 latency per endpoint; as `endpoint_popularity`."""
    some = last_days(sketches, as_of, days)
    return latency_quantiles_from(some, ["endpoint_path"], {"p95_latency_ms": 0.95}).orderBy(F.desc("hits"), "endpoint_path")


def latency_percentiles_from(sketches: DataFrame) -> DataFrame:
    """p50, p95 and p99 of the response time; as `latency_percentiles`."""
    return latency_quantiles_from(sketches, [], {"p50": 0.5, "p95": 0.95, "p99": 0.99}).select("p50", "p95", "p99")


def rank_shares(rows: DataFrame, quantiles: DataFrame, keys: Sequence[str], value: str, names: Sequence[str]) -> DataFrame:
    """Exact share of a key's values below each of its quantiles, and up to it: what a rank error is measured by.

    Columns `<name>_below` and `<name>_upto`. One pass over the rows; a key's quantiles are one row.
    """
    asked = quantiles.select(*[F.col(k).alias(f"_{k}") for k in keys], *names)
    known = rows.where(F.col(value).isNotNull()).select(*keys, value)
    if keys:
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        met = known.join(asked, same)
    else:
        met = known.crossJoin(F.broadcast(asked))  # one row
    shares = []
    for name in names:
        for what, under in (("below", F.col(value) < F.col(name)), ("upto", F.col(value) <= F.col(name))):
            shares.append((F.count_if(under) / F.count(F.lit(1))).alias(f"{name}_{what}"))
    return met.groupBy(*keys).agg(*shares)


# -- frequent items ------------------------------------------------------------


def frequent_items(log: DataFrame, keys: Sequence[str], item: str, kept: int = ITEMS) -> DataFrame:
    """(keys, n, missing, items): the items that make up most of each key's rows, at most `kept` of them.

    `items` holds (item, at_least); an item's count lies between `at_least` and `at_least + missing`, and is at most
    `missing` if it is not listed. `missing` is at most n / (kept + 1), so every item with more rows than that is listed.
    NULL is an item. Keys keep their NULLs.
    """
    mark = F.pmod(F.xxhash64(item), F.lit(SLICES)).alias("_slice")
    counted = log.groupBy(*keys, F.col(item).alias("item"), mark).agg(F.count(F.lit(1)).alias("at_least"))
    # Each slice's items are cut down on their own, exactly as summaries of several days are merged.
    sliced = _cut(counted, [*keys, "_slice"], kept)
    return merge_frequent(sliced.drop("_slice"), keys, kept)


def merge_frequent(summaries: DataFrame, keys: Sequence[str], kept: int = ITEMS) -> DataFrame:
    """One summary per key of any number of them; bounds hold, and `missing` stays within n / (kept + 1)."""
    totals = summaries.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("missing").alias("_missing"))
    listed = summaries.select(*keys, F.explode("items").alias("_i")).groupBy(*keys, F.col("_i.item").alias("item"))
    cut = _cut(listed.agg(F.sum("_i.at_least").alias("at_least")), keys, kept)
    renamed = cut.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("missing").alias("_cut"), "items")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return totals.join(renamed, same).select(*keys, "n", (F.col("_missing") + F.col("_cut")).alias("missing"), "items")


def _cut(counts: DataFrame, keys: Sequence[str], kept: int) -> DataFrame:
    """Counts cut down to `kept` items per key: the next largest count is taken off all of them.

    That count times kept + 1 rows are thus accounted for, which bounds what is ever missing.
    """
    order = [F.desc("at_least"), F.xxhash64("item"), F.col("item").isNull(), "item"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = counts.withColumn("_place", place).where(F.col("_place") <= kept + 1)
    off = F.coalesce(F.max(F.when(F.col("_place") == kept + 1, F.col("at_least"))), F.lit(0))
    total = counts.groupBy(*keys).agg(F.sum("at_least").alias("n")).select(*[F.col(k).alias(f"_t_{k}") for k in keys], "n")
    lists = first.groupBy(*keys).agg(off.alias("missing"), F.collect_list(F.struct("item", "at_least")).alias("items"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    less = F.filter(
        F.transform("items", lambda x: F.struct(x["item"].alias("item"), (x["at_least"] - F.col("missing")).alias("at_least"))),
        lambda x: x["at_least"] > 0,
    )
    return lists.join(total, same).select(*keys, "n", "missing", less.alias("items"))


def top_items(summaries: DataFrame, keys: Sequence[str], k: int = 1) -> DataFrame:
    """(keys, place, item, at_least, at_most) of the k most frequent items of a summary; ties by name, NULL last."""
    order = F.array_sort(F.transform("items", lambda x: F.struct((-x["at_least"]).alias("a"), x["item"].isNull().alias("b"), x["item"].alias("c"))))
    places = summaries.select(*keys, "missing", F.posexplode(F.slice(order, 1, k)).alias("_at", "_i"))
    return places.select(
        *keys,
        (F.col("_at") + 1).alias("place"),
        F.col("_i.c").alias("item"),
        (-F.col("_i.a")).alias("at_least"),
        (F.col("missing") - F.col("_i.a")).alias("at_most"),
    )
