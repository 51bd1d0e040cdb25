"""Warehouse reports over the request log.

Every report is one or two hash aggregations that combine on the map side, so a
domain or campaign holding a third of the log costs one partial row per task.
`RANK()` runs over rows that are already one per domain, cut to k per task first; sources
are ranked by running counts over ranges of rates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.prefix import ranked
from ..functions.stats import (
    approx_quantiles, exact_quantiles, mean, mean_of, percent, value_counts,
)
from ..functions.times import as_of_column, back, since

LATENCY = "response_time_ms"


def _n_ok():
    return F.count_if(F.col("http_status_code") == 200)


def _hits():
    return F.count(F.lit(1))


def domain_hits(log: DataFrame) -> DataFrame:
    """Requests per domain, busiest first."""
    return (
        log.groupBy("recruiter_domain")
        .agg(_hits().alias("total_hits"))
        .orderBy(F.desc("total_hits"), "recruiter_domain")
    )


def top_domain(log: DataFrame) -> DataFrame:
    """The busiest domain."""
    return domain_hits(log).limit(1)


def top_domain_recent(log: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """The busiest domain of the last days; prunes date partitions."""
    return top_domain(since(log, as_of, days=days))


def distinct_domains(log: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return log.agg(count("recruiter_domain").alias("distinct_domains"))


def domain_scorecard(
    log: DataFrame, as_of=None, days: int = 90, k: int = 10, ignore_null: bool = False
) -> DataFrame:
    """Volume, success, latency, favourite skill and rank of the top domains.

    One scan, one shuffle of rows already counted per (domain, skill); the
    most frequent skill falls out of the same partial counts. NULL counts as
    a skill unless `ignore_null`; ties go to the first name, NULL last.
    """
    per_skill = (
        since(log, as_of, days=days)
        .groupBy("recruiter_domain", "skill_searched")
        .agg(
            _hits().alias("n"),
            _n_ok().alias("n_ok"),
            F.sum(LATENCY).alias("ms"),
            F.count(LATENCY).alias("n_ms"),
            F.min("request_timestamp").alias("first"),
            F.max("request_timestamp").alias("last"),
        )
    )
    skill = F.col("skill_searched")
    contest = F.struct(-F.col("n"), skill.isNull(), skill)
    if ignore_null:
        contest = F.when(skill.isNotNull(), contest)
    stats = per_skill.groupBy("recruiter_domain").agg(
        F.sum("n").alias("total_hits"),
        F.sum("n_ok").alias("successful_hits"),
        mean_of(F.sum("ms"), F.sum("n_ms")).alias("avg_response_ms"),
        F.min(contest)["skill_searched"].alias("top_skill_searched"),
        F.min("first").alias("first_visit"),
        F.max("last").alias("last_visit"),
    )
    return (
        stats.withColumn(
            "activity_rank", F.rank().over(Window.orderBy(F.desc("total_hits")))
        )
        .where(F.col("activity_rank") <= k)
        .withColumn(
            "success_rate_pct", percent(F.col("successful_hits"), F.col("total_hits"), 1)
        )
        .withColumn(
            "engagement_span_days",
            F.datediff(F.to_date("last_visit"), F.to_date("first_visit")),
        )
        .orderBy("activity_rank", "recruiter_domain")
    )


def domain_rank_first(log: DataFrame) -> DataFrame:
    """The domain (or tied domains) with most requests."""
    stats = log.groupBy("recruiter_domain").agg(
        _hits().alias("total_hits"),
        _n_ok().alias("successful_hits"),
        mean(F.col(LATENCY)).alias("avg_response_ms"),
    )
    return (
        stats.withColumn(
            "activity_rank", F.rank().over(Window.orderBy(F.desc("total_hits")))
        )
        .where(F.col("activity_rank") == 1)
        .withColumn(
            "success_rate_pct", percent(F.col("successful_hits"), F.col("total_hits"), 1)
        )
    )


def endpoint_quantiles(
    log: DataFrame,
    as_of=None,
    domains: Sequence[str] = ("google.com", "amazon.com"),
    from_days: int = 60,
    to_days: int = 30,
    approximate: bool = False,
) -> DataFrame:
    """Hits, p95 and p50 per domain and endpoint between two days, inclusive."""
    end = as_of_column(log, as_of)
    day = F.col("date") if "date" in log.columns else F.to_date("request_timestamp")
    window = log.where(
        day.between(
            F.to_date(back(end, days=from_days)), F.to_date(back(end, days=to_days))
        )
        & F.col("recruiter_domain").isin(list(domains))
    )
    keys = ["recruiter_domain", "endpoint_path"]
    return _with_quantiles(
        window, keys, {"p95_response_ms": 0.95, "p50_response_ms": 0.5}, approximate
    ).orderBy(F.desc("hits"), *keys)


def _with_quantiles(rows, keys, probs, approximate, mean_name=None) -> DataFrame:
    """Hits, optionally the mean latency, and latency quantiles per key."""
    if approximate:
        extra = [mean(F.col(LATENCY)).alias(mean_name)] if mean_name else []
        plain = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"), *extra)
        quantiles = approx_quantiles(rows, keys, LATENCY, probs)
    else:
        counts = value_counts(rows, keys, LATENCY)
        n = F.col("_n")
        total = F.sum(F.col(LATENCY) * n)
        known = F.sum(F.when(F.col(LATENCY).isNotNull(), n))
        extra = [mean_of(total, known).alias(mean_name)] if mean_name else []
        plain = counts.groupBy(*keys).agg(F.sum(n).alias("hits"), *extra)
        quantiles = exact_quantiles(counts, keys, LATENCY, probs)
    renamed = quantiles.withColumnsRenamed({k: f"_q_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in keys]
    return plain.join(renamed, same, "left").drop(*[f"_q_{k}" for k in keys])


def recent_top_domains(
    log: DataFrame, as_of=None, hours: int = 24, limit: int = 10
) -> DataFrame:
    return (
        since(log, as_of, hours=hours)
        .groupBy("recruiter_domain")
        .agg(
            _hits().alias("total_hits"),
            mean(F.col(LATENCY)).alias("avg_response_ms"),
            _n_ok().alias("successful_hits"),
            percent(_n_ok(), _hits(), 1).alias("success_rate_pct"),
        )
        .orderBy(F.desc("total_hits"), "recruiter_domain")
        .limit(limit)
    )


def hourly_traffic(log: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    return (
        since(log, as_of, days=days)
        .groupBy(F.hour("request_timestamp").alias("hour_of_day"))
        .agg(_hits().alias("requests"), mean(F.col(LATENCY)).alias("avg_latency_ms"))
        .orderBy("hour_of_day")
    )


def endpoint_popularity(
    log: DataFrame, as_of=None, days: int = 7, approximate: bool = False
) -> DataFrame:
    return _with_quantiles(
        since(log, as_of, days=days),
        ["endpoint_path"],
        {"p95_latency_ms": 0.95},
        approximate,
        "avg_latency_ms",
    ).orderBy(F.desc("hits"), "endpoint_path")


def load_health(log: DataFrame, limit: int = 7) -> DataFrame:
    """Rows, extent and distinct domains of the newest request days.

    The days are found first (`limit` values reach the driver), so that a table
    partitioned by `date` is read for these days only. Rows without a day are
    one, the oldest.
    """
    if "date" not in log.columns:
        log = log.withColumn("date", F.to_date("request_timestamp"))
    newest = log.select("date").distinct().orderBy(F.desc_nulls_last("date")).limit(limit).collect()
    days = [r["date"] for r in newest if r["date"] is not None]
    wanted = F.col("date").isin(days) if days else F.lit(False)
    if len(days) < len(newest):
        wanted = wanted | F.col("date").isNull()
    return (
        log.where(wanted)
        .groupBy(F.col("date").alias("sync_date"))
        .agg(
            _hits().alias("records"),
            F.min("request_timestamp").alias("earliest"),
            F.max("request_timestamp").alias("latest"),
            F.count_distinct("recruiter_domain").alias("unique_domains"),
        )
        .orderBy(F.desc("sync_date"))
    )


def last_sync_status(log: DataFrame, ledger: DataFrame, limit: int = 7) -> DataFrame:
    """Rows per day and the time of the last sync."""
    last = ledger.agg(F.max("synced_at")).scalar()
    return load_health(log, limit).select("sync_date", "records").withColumn(
        "last_synced_at", last
    )


def skill_searches(log: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Searched keywords; a parameter without a value forms the NULL group."""
    keyword = F.nullif(
        F.regexp_extract("query_params", fv.KEYWORD_PARAM, 1), F.lit("")
    )
    return (
        since(log, as_of, days=days)
        .where(
            (F.col("endpoint_path") == fv.SKILLS_ENDPOINT)
            & F.col("query_params").like("%keyword%")
        )
        .groupBy(keyword.alias("skill_searched"))
        .agg(
            _hits().alias("search_count"),
            F.count_distinct("recruiter_domain").alias("unique_recruiters"),
        )
        .orderBy(F.desc("search_count"), F.asc_nulls_last("skill_searched"))
    )


def _stage(name: str):
    return F.col("funnel_stage") == name


def _reached(name: str):
    return F.max(F.when(_stage(name), 1).otherwise(0))


def _staged(log: DataFrame, as_of, days: int) -> DataFrame:
    return since(log, as_of, days=days).where(F.col("funnel_stage").isNotNull())


def funnel_by_campaign(log: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    sessions = (
        _staged(log, as_of, days)
        .groupBy("session_id", "search_campaign", "traffic_source")
        .agg(
            _reached("impression").alias("had_impression"),
            _reached("engagement").alias("had_engagement"),
            _reached("contact").alias("had_contact"),
        )
    )
    return (
        sessions.groupBy("search_campaign")
        .agg(
            _hits().alias("total_sessions"),
            F.sum("had_impression").alias("impressions"),
            F.sum("had_engagement").alias("engagements"),
            F.sum("had_contact").alias("contacts"),
        )
        .withColumn(
            "engagement_rate_pct", percent(F.col("engagements"), F.col("impressions"), 2)
        )
        .withColumn(
            "conversion_rate_pct", percent(F.col("contacts"), F.col("impressions"), 2)
        )
        .orderBy(F.desc("total_sessions"), "search_campaign")
    )


def funnel_dropoff(log: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """Distinct sessions per stage, step rates and losses.

    Sessions are reduced to three flags first, then summed: three conditional
    distinct counts would multiply the log by three.
    """
    sessions = (
        _staged(log, as_of, days)
        .where(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            _reached("impression").alias("s1"),
            _reached("engagement").alias("s2"),
            _reached("contact").alias("s3"),
        )
    )
    totals = sessions.agg(
        *[
            F.coalesce(F.sum(flag), F.lit(0)).alias(name)
            for flag, name in (
                ("s1", "step_1_impressions"),
                ("s2", "step_2_engagements"),
                ("s3", "step_3_contacts"),
            )
        ]
    )
    one, two, three = (F.col(c) for c in totals.columns)
    return totals.select(
        one,
        two,
        three,
        percent(two, one, 1).alias("impression_to_engagement_pct"),
        percent(three, two, 1).alias("engagement_to_contact_pct"),
        percent(three, one, 1).alias("overall_conversion_pct"),
        (one - two).alias("dropped_after_impression"),
        (two - three).alias("dropped_after_engagement"),
    )


def conversion_by_source(log: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Conversion per traffic source, ranked by the unrounded rate."""
    sessions = (
        _staged(log, as_of, days)
        .groupBy("session_id", "traffic_source")
        .agg(_reached("contact").alias("converted"))
    )
    sources = sessions.groupBy("traffic_source").agg(
        _hits().alias("total_sessions"), F.sum("converted").alias("conversions")
    )
    rate = F.try_divide(F.col("conversions"), F.col("total_sessions"))
    return (
        ranked(sources.withColumn("_rate", rate), "_rate", "source_rank")
        .select(
            *sources.columns,
            percent(F.col("conversions"), F.col("total_sessions"), 2).alias("conversion_rate_pct"),
            "source_rank",
        )
        .orderBy(F.desc("conversion_rate_pct"), "traffic_source")
    )


def campaign_device_region(log: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    impressions = F.count_if(_stage("impression"))
    contacts = F.count_if(_stage("contact"))
    keys = ["search_campaign", "device_type", "geo_region"]
    return (
        _staged(log, as_of, days)
        .groupBy(*keys)
        .agg(
            F.count_distinct("session_id").alias("sessions"),
            _hits().alias("total_events"),
            impressions.alias("impressions"),
            F.count_if(_stage("engagement")).alias("engagements"),
            contacts.alias("contacts"),
            mean(F.col(LATENCY)).alias("avg_latency_ms"),
            percent(contacts, impressions, 2).alias("cvr_pct"),
        )
        .where(F.col("impressions") > 0)
        .orderBy(F.desc("sessions"), *keys)
    )


def session_parts(rows: DataFrame, *extra_keys) -> DataFrame:
    """Rows reduced to one per (session, campaign, endpoint).

    Fixed-size parts: batch and streaming roll them up with the same code and
    no session ever carries a set of its endpoints.
    """
    micros = F.unix_micros("request_timestamp")
    keys = ["session_id", "search_campaign", "endpoint_path", *extra_keys]
    return rows.groupBy(*keys).agg(
        _hits().alias("n"),
        _reached("contact").alias("converted"),
        F.min(micros).alias("first_us"),
        F.max(micros).alias("last_us"),
    )


def session_depth_of(parts: DataFrame) -> DataFrame:
    """Per campaign averages from `session_parts`."""
    sessions = parts.groupBy("session_id", "search_campaign").agg(
        F.count("endpoint_path").alias("sections"),
        F.max("converted").alias("converted"),
        (F.max("last_us") - F.min("first_us")).alias("duration_us"),
    )

    def avg_sections(keep):
        return F.round(
            F.avg(F.when(keep, F.col("sections")).cast("double")), 1
        )

    return (
        sessions.groupBy("search_campaign")
        .agg(
            avg_sections(F.lit(True)).alias("avg_sections_viewed"),
            F.round(
                F.sum("duration_us").cast("double") / F.count(F.lit(1)) / 1_000_000, 1
            ).alias("avg_session_duration_sec"),
            avg_sections(F.col("converted") == 1).alias("avg_sections_converters"),
            avg_sections(F.col("converted") == 0).alias("avg_sections_non_converters"),
        )
        .orderBy(F.desc("avg_sections_viewed"), "search_campaign")
    )


def session_depth(log: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """Do sessions that see more endpoints convert? Averages per campaign."""
    return session_depth_of(session_parts(_staged(log, as_of, days)))


def funnel_stage_counts(log: DataFrame) -> DataFrame:
    return (
        log.where(F.col("funnel_stage").isNotNull())
        .groupBy("funnel_stage")
        .agg(_hits().alias("events"), F.count_distinct("session_id").alias("sessions"))
        .orderBy(F.desc("events"), "funnel_stage")
    )


def log_extent(log: DataFrame) -> DataFrame:
    return log.agg(
        _hits().alias("rows"),
        F.min("request_timestamp").alias("first"),
        F.max("request_timestamp").alias("last"),
    )


def campaign_event_counts(log: DataFrame) -> DataFrame:
    return (
        log.where(F.col("search_campaign").isNotNull())
        .groupBy("search_campaign")
        .agg(_hits().alias("events"))
        .orderBy(F.desc("events"), "search_campaign")
    )
