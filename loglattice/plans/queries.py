"""Every operator run over the shared tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import stored
from ..functions.times import newest
from ..operators import documents as docs
from ..operators import (
    id_ledger, log_api, log_reports, log_sketches, pattern_index, profiles, retrieval, screening, sync,
    vector_index,
)
from ..schemas import HISTORIC_LOG, SKILL_ANALYSIS, WEAK_MATCH
from ..session import prepare, scratch_path
from ..sources import clustering, corpus, jsonl, logs
from ..streaming import flags as flag_streams
from ..streaming import logs as log_streams
from ..streaming import table_sync, windows
from . import derived as d

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

LONG_TTL = 21_600  # flags rarely meet at 300 s in the shared events


def query(fn: Query) -> Query:
    """Register a query under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _log(spark, sf):
    return d.request_log(d.table(spark, sf, "events"))


def _report(name: str, operator, **options) -> None:
    """Register a report that takes the request log and nothing else."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(_log(prepare(spark), sf_dir), **options)

    QUERIES[name] = run


# -- log reports ---------------------------------------------------------------

for _operator in (
    log_reports.domain_hits,
    log_reports.top_domain,
    log_reports.distinct_domains,
    log_reports.domain_scorecard,
    log_reports.domain_rank_first,
    log_reports.recent_top_domains,
    log_reports.hourly_traffic,
    log_reports.endpoint_popularity,
    log_reports.load_health,
    log_reports.skill_searches,
    log_reports.funnel_by_campaign,
    log_reports.funnel_dropoff,
    log_reports.conversion_by_source,
    log_reports.campaign_device_region,
    log_reports.session_depth,
    log_reports.funnel_stage_counts,
    log_reports.log_extent,
    log_reports.campaign_event_counts,
    log_api.query_log_page,
    log_api.top_domains,
    log_api.latency_percentiles,
):
    _report(_operator.__name__, _operator)

_report("domain_scorecard_known_skills", log_reports.domain_scorecard, ignore_null=True)
_report("query_log_page_of_domain", log_api.query_log_page, domain="google.com", limit=20, offset=5)
_report("endpoint_quantiles", log_reports.endpoint_quantiles, from_days=20, to_days=5)
_report("distinct_values", log_api.distinct_values, column="client_ip", limit=5)
_report("distinct_campaigns", log_api.distinct_values, column="search_campaign", limit=5)


_report("query_log_page_deep", log_api.query_log_page_ranged, limit=50, offset=700)


@query
def top_domains_map(spark, sf):
    """The map form, a row per entry."""
    return log_api.top_domains_map(_log(spark, sf)).select(F.explode("top_domains").alias("domain", "hits"))


def _partitioned_log(spark, sf) -> DataFrame:
    path = scratch_path(spark, "log-by-day")
    logs.write_partitioned(_log(spark, sf), path)
    return spark.read.parquet(path)


@query
def top_domain_recent(spark, sf):
    log = _partitioned_log(spark, sf)
    return log_reports.top_domain_recent(log, newest(log), days=10)


@query
def endpoint_quantiles_by_day(spark, sf):
    log = _partitioned_log(spark, sf)
    return log_reports.endpoint_quantiles(log, newest(log), from_days=12, to_days=3)


@query
def last_sync_status(spark, sf):
    ledger = d.sync_ledger(d.table(spark, sf, "events"))
    return log_reports.last_sync_status(_log(spark, sf), ledger)


# -- daily summaries: each report from stored sketches, held against exact figures -------------


def _stored(spark, summary: DataFrame) -> DataFrame:
    path = scratch_path(spark, "daily")
    log_sketches.write_daily(summary, path)
    return spark.read.parquet(path)


def _within(estimate, exact, margin):
    return F.abs(estimate - exact) <= margin


@query
def funnel_dropoff_sketched(spark, sf):
    """Each figure of the sketched drop-off: what it is exactly, and whether the sketch keeps its bound."""
    log = _log(spark, sf)
    got = log_sketches.funnel_dropoff_from(_stored(spark, log_sketches.funnel_sketches(log)))
    staged = log_sketches.last_days(log, None, 7).where("funnel_stage IS NOT NULL AND session_id IS NOT NULL")
    flags = staged.groupBy("session_id").agg(
        *[F.max(F.col("funnel_stage") == s).alias(n) for s, n in zip(log_sketches.STAGES, "iec")]
    )
    exact = {
        "sessions": "true", "step_1_impressions": "i", "step_2_engagements": "e", "step_3_contacts": "c",
        "engaged": "i AND e", "completed": "i AND e AND c", "lost_after_impression": "i AND NOT e",
        "lost_after_engagement": "i AND e AND NOT c",
    }
    truth = flags.agg(*[F.count_if(F.expr(e)).alias(f"x_{m}") for m, e in exact.items()])
    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"x_{m}").alias("exact"),
            _within(F.col(m), F.col(f"x_{m}"), F.col("error") * F.col("x_sessions") + 1).alias("within_bound"),
        )
        for m in exact
    ]
    return got.crossJoin(truth).select(F.inline(F.array(*rows)))


@query
def funnel_by_campaign_sketched(spark, sf):
    log = _log(spark, sf)
    got = log_sketches.funnel_by_campaign_from(_stored(spark, log_sketches.funnel_sketches(log)))
    staged = log_sketches.last_days(log, None, 7).where("funnel_stage IS NOT NULL")
    visits = staged.groupBy("session_id", "search_campaign", "traffic_source").agg(
        *[F.max(F.col("funnel_stage") == s).alias(f"x_{s}s") for s in log_sketches.STAGES]
    )
    names = [f"{s}s" for s in log_sketches.STAGES]
    truth = visits.groupBy(F.col("search_campaign").alias("campaign")).agg(
        F.count(F.lit(1)).alias("x_total_sessions"), *[F.count_if(f"x_{n}").alias(f"x_{n}") for n in names]
    )
    kept = F.lit(True)
    for n in ["total_sessions", *names]:
        kept &= _within(F.col(n), F.col(f"x_{n}"), log_sketches.theta_error() * F.col(f"x_{n}") + 1)
    return got.join(truth, F.col("search_campaign").eqNullSafe(F.col("campaign"))).select(
        "search_campaign", *[F.col(f"x_{n}").alias(n) for n in ["total_sessions", *names]], kept.alias("within_bound")
    )


def _ranked(rows, quantiles, keys, probs):
    """Whether each quantile's rank among the rows is within the sketch's bound."""
    shares = log_sketches.rank_shares(rows, quantiles, keys, "response_time_ms", list(probs))
    error = log_sketches.kll_error()
    ok = [
        ((F.col(f"{n}_below") <= p + error) & (F.col(f"{n}_upto") >= p - error)).alias(f"{n}_within_bound")
        for n, p in probs.items()
    ]
    return shares.select(*keys, *ok)


@query
def endpoint_quantiles_sketched(spark, sf):
    log, keys = _log(spark, sf), ["recruiter_domain", "endpoint_path"]
    sketches = _stored(spark, log_sketches.latency_sketches(log))
    got = log_sketches.endpoint_quantiles_from(sketches, from_days=20, to_days=5)
    day = F.to_date(F.lit(newest(log)))
    rows = log.where(F.col("date").between(F.date_sub(day, 20), F.date_sub(day, 5)))
    return got.select(*keys, "hits").join(
        _ranked(rows, got, keys, {"p95_response_ms": 0.95, "p50_response_ms": 0.5}), keys
    )


@query
def endpoint_popularity_sketched(spark, sf):
    log, keys = _log(spark, sf), ["endpoint_path"]
    got = log_sketches.endpoint_popularity_from(_stored(spark, log_sketches.latency_sketches(log)))
    rows = log_sketches.last_days(log, None, 7)
    return got.drop("p95_latency_ms").join(_ranked(rows, got, keys, {"p95_latency_ms": 0.95}), keys)


@query
def latency_percentiles_sketched(spark, sf):
    log = _log(spark, sf)
    got = log_sketches.latency_percentiles_from(_stored(spark, log_sketches.latency_sketches(log)))
    return _ranked(log, got, [], {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query
def domain_skills_sketched(spark, sf):
    """Frequent skills per domain from daily summaries of four items: bounds, and whether all that must be found are."""
    log, keys, kept = _log(spark, sf), ["recruiter_domain"], 4
    daily = _stored(spark, log_sketches.frequent_items(log, ["date", *keys], "skill_searched", kept))
    merged = log_sketches.merge_frequent(daily, keys, kept)
    counts = log.groupBy(*keys, "skill_searched").agg(F.count(F.lit(1)).alias("exact"))
    joined = counts.join(merged, keys)
    listed = F.filter("items", lambda x: x["item"].eqNullSafe(F.col("skill_searched")))
    at_least = F.coalesce(F.try_element_at(listed, F.lit(1))["at_least"], F.lit(0))
    return joined.groupBy(*keys).agg(
        F.first("n").alias("hits"),
        F.every((F.col("exact") >= at_least) & (F.col("exact") <= at_least + F.col("missing"))).alias("bounds_hold"),
        F.every((at_least > 0) | (F.col("exact") <= log_sketches.items_error(F.col("n"), kept))).alias("frequent_found"),
        (F.first("missing") <= log_sketches.items_error(F.first("n"), kept)).alias("missing_within_bound"),
    )


@query
def distinct_domains_approx(spark, sf):
    """The approximate count of domains against the exact one: within three times five percent."""
    log = _log(spark, sf)
    near = log_reports.distinct_domains(log, approximate=True).withColumnRenamed("distinct_domains", "near")
    exact = log_reports.distinct_domains(log)
    margin = F.col("distinct_domains") * 0.15
    return exact.crossJoin(near).select(
        "distinct_domains", _within(F.col("near"), F.col("distinct_domains"), margin).alias("within_bound")
    )


# -- sources and sinks ---------------------------------------------------------


@query
def read_access_log(spark, sf):
    path = scratch_path(spark, "live-log")
    d.live_log(d.table(spark, sf, "events")).write.parquet(path)
    return logs.read_access_log(spark, path).drop("created_at", "timestamp")


def _historic(spark, sf) -> DataFrame:
    return d.historic_log(d.table(spark, sf, "events"))


@query
def write_csv_log(spark, sf):
    """CSV round trip with fixed types."""
    path = scratch_path(spark, "csv-log")
    logs.write_csv_log(_historic(spark, sf), path)
    return logs.read_csv_log(spark, path, infer=False).select(*HISTORIC_LOG.fieldNames())


@query
def read_csv_log(spark, sf):
    """CSV round trip with detected types, then a report on it."""
    path = scratch_path(spark, "csv-log")
    logs.write_csv_log(_historic(spark, sf), path)
    log = logs.historic_to_log(logs.read_csv_log(spark, path))
    return log_reports.domain_scorecard(log)


@query
def read_csv_log_rows(spark, sf):
    """The rows of the CSV log as their types are detected."""
    path = scratch_path(spark, "csv-log")
    logs.write_csv_log(_historic(spark, sf), path)
    return logs.read_csv_log(spark, path).select(*HISTORIC_LOG.fieldNames())


@query
def append_log_stream(spark, sf):
    path, checkpoint = scratch_path(spark, "log"), scratch_path(spark, "state")
    log_streams.append_log_stream(d.live_log(_event_stream(spark, sf)), path, checkpoint).checked()
    return logs.read_access_log(spark, path).drop("created_at", "timestamp")


def _results(spark, sf) -> DataFrame:
    """Retrieval results of every question."""
    return retrieval.retrieve_tiers(_questions(spark, sf), _tiers(spark, sf))


def _asked_at():
    return F.timestamp_seconds(F.lit(1_704_067_200) + F.col("question_id"))


@query
def write_jsonl(spark, sf):
    """Weak matches appended in two writes and read back."""
    path = scratch_path(spark, "weak")
    # Kept between the two writes, or each would search anew.
    weak = stored(retrieval.weak_matches(_results(spark, sf), asked_at=_asked_at()), "weak-matches")
    jsonl.write_jsonl(weak.where(F.col("top_distance") <= 0.8), path)
    jsonl.write_jsonl(weak.where(F.col("top_distance") > 0.8), path)
    return jsonl.read_jsonl_tolerant(spark, path)


@query
def read_jsonl_tolerant(spark, sf):
    """Records read from lines of which some are blank or corrupt."""
    path = scratch_path(spark, "lines")
    record = F.to_json(
        F.struct(
            F.lit("2024-01-01T00:00:00+00:00").alias("ts"),
            F.concat(F.lit("question "), "conv_id", F.lit("/"), "turn").alias("question"),
            (F.col("turn") * 0.125).alias("top_distance"),
            (F.col("turn") > 5).alias("low_confidence"),
        )
    )
    key = F.col("conv_id") + F.col("turn")
    line = F.when(key % 5 == 0, "").when(key % 7 == 0, F.substring(record, 1, 25)).otherwise(record)
    d.table(spark, sf, "conversations").select(line.alias("value")).write.text(path)
    return jsonl.read_jsonl_tolerant(spark, path, WEAK_MATCH)


@query
def read_text_corpus(spark, sf):
    """Documents written as text files of bounded size, read back whole."""
    path = scratch_path(spark, "corpus")
    (
        d.table(spark, sf, "documents").select("lang", "text").write.partitionBy("lang")
        .option("maxRecordsPerFile", 10_000).text(path)
    )
    files = corpus.read_text_corpus(spark, path)
    lang = F.regexp_extract("path", "lang=([a-z]+)", 1)
    return files.groupBy(lang.alias("lang")).agg(F.sum(F.length("text")).alias("n_chars"))


@query
def read_text_corpus_lines(spark, sf):
    """Every line of the corpus read from files: language, digest, how often."""
    path = scratch_path(spark, "corpus")
    d.table(spark, sf, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    files = corpus.read_text_corpus(spark, path)
    lines = files.select(
        F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang"),
        F.explode(F.split(F.regexp_replace("text", "\n\\z", ""), "\n")).alias("line"),
    )
    return lines.groupBy("lang", F.md5("line").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query
def write_partitioned(spark, sf):
    log = _partitioned_log(spark, sf)
    return log.groupBy("date", "recruiter_domain").agg(
        F.count(F.lit(1)).alias("hits"), F.min("query_id").alias("first_id")
    )


@query
def write_clustered(spark, sf):
    """Written along a curve over both keys, in many small files; whole rows are compared."""
    path = scratch_path(spark, "clustered")
    clustering.write_clustered(_log(spark, sf), path, bytes_per_file=1 << 20)
    return spark.read.parquet(path).select("query_id", "date", "recruiter_domain", "endpoint_path", "response_time_ms")


@query
def replicate_rows(spark, sf):
    copies = logs.replicate_rows(_log(spark, sf), 10)
    return copies.groupBy("recruiter_domain").agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_distinct("query_id").alias("ids"),
        F.max("query_id").alias("last_id"),
    )


@query
def table_row_counts(spark, sf):
    names = (
        "region nation customer supplier part orders lineitem events documents "
        "embeddings pages benchmark labels conversations"
    ).split()
    return logs.table_row_counts({name: d.table(spark, sf, name) for name in names})


# -- incremental sync ----------------------------------------------------------


@query
def derive_referer_domain(spark, sf):
    pages = d.table(spark, sf, "pages").select("page_id", F.col("url").alias("referer_url"))
    return sync.derive_referer_domain(pages)


@query
def enrich_requests(spark, sf):
    raw = d.raw_requests(d.table(spark, sf, "events"))
    return sync.enrich_requests(raw).drop("created_at", "timestamp")


def _live(spark, sf) -> DataFrame:
    return d.live_log(d.table(spark, sf, "events"))


def _ledger(spark, sf) -> DataFrame:
    return d.sync_ledger(d.table(spark, sf, "events"))


@query
def unsynced_batch(spark, sf):
    batch = sync.unsynced_batch(_live(spark, sf), _ledger(spark, sf))
    return batch.select("query_id", "path", "recruiter_domain")


@query
def to_warehouse(spark, sf):
    return sync.to_warehouse(_live(spark, sf)).drop("created_at")


@query
def append_warehouse(spark, sf):
    """Two appends; rows per day of the table they leave."""
    path = scratch_path(spark, "warehouse")
    rows = sync.to_warehouse(_live(spark, sf))
    noon = F.col("hour_of_day") < 12
    sync.append_warehouse(rows.where(noon), path)
    sync.append_warehouse(rows.where(~noon), path)
    return spark.read.parquet(path).groupBy("date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("query_id").alias("ids")
    )


@query
def append_warehouse_rows(spark, sf):
    """The rows that two appends leave."""
    path = scratch_path(spark, "warehouse")
    rows = sync.to_warehouse(_live(spark, sf))
    noon = F.col("hour_of_day") < 12
    sync.append_warehouse(rows.where(noon), path)
    sync.append_warehouse(rows.where(~noon), path)
    return spark.read.parquet(path).drop("created_at")


@query
def mark_synced(spark, sf):
    marked = sync.mark_synced(_live(spark, sf), _ledger(spark, sf))
    return marked.select("query_id", "recruiter_domain", "synced")


@query
def run_sync(spark, sf):
    """The live log synced twice; the warehouse holds every row once."""
    source, warehouse = scratch_path(spark, "live-log"), scratch_path(spark, "warehouse")
    ledger, checkpoint = scratch_path(spark, "ledger"), scratch_path(spark, "state")
    _live(spark, sf).write.parquet(source)
    for _ in range(2):
        _succeeded(log_streams.run_sync(spark, source, warehouse, ledger, checkpoint))
    ids = spark.read.parquet(ledger).select("query_id")
    return sync.mark_synced(spark.read.parquet(warehouse), ids).drop("stream", "batch_id")


@query
def unsynced_batch_bitmap(spark, sf):
    ledger = id_ledger.bitmap_ledger(_ledger(spark, sf))
    batch = id_ledger.unsynced_by_bitmap(_live(spark, sf), ledger)
    return batch.select("query_id", "path", "recruiter_domain")


@query
def mark_synced_bitmap(spark, sf):
    """The ledger in two parts that share half of their ids."""
    ids = _ledger(spark, sf)
    parts = id_ledger.bitmap_ledger(ids).union(id_ledger.bitmap_ledger(ids.where("query_id % 2 = 0")))
    marked = id_ledger.mark_synced_by_bitmap(_live(spark, sf), parts)
    return marked.select("query_id", "recruiter_domain", "synced")


@query
def sync_status_bitmap(spark, sf):
    return id_ledger.sync_status_by_bitmap(_live(spark, sf), id_ledger.bitmap_ledger(_ledger(spark, sf)))


@query
def run_sync_table(spark, sf):
    """The live log synced twice into committed tables, the second time from a new checkpoint."""
    source, path = scratch_path(spark, "live-log"), scratch_path(spark, "tables")
    _live(spark, sf).write.parquet(source)
    for _ in range(2):
        _succeeded(table_sync.run_sync_table(spark, source, path, scratch_path(spark, "state")))
    tables = table_sync.warehouse_tables(spark, path)
    return id_ledger.mark_synced_by_bitmap(tables.read("rows"), tables.read("ledger"))


def _succeeded(summary: DataFrame) -> None:
    if not summary.first()["success"]:
        raise RuntimeError("the sync failed; see the log")


@query
def sync_status(spark, sf):
    return sync.sync_status(_live(spark, sf), _ledger(spark, sf))


# -- documents -----------------------------------------------------------------


def _documents(spark, sf) -> DataFrame:
    """The documents, which come in one file, dealt to all cores."""
    return docs.dealt(d.probe_documents(d.table(spark, sf, "documents")))


@query
def chunk_lines(spark, sf):
    return docs.chunk_lines(_documents(spark, sf).select("doc_id", "text"))


@query
def chunk_words(spark, sf):
    return docs.chunk_words(_documents(spark, sf).select("doc_id", "source", "text"))


@query
def tag_documents(spark, sf):
    i = F.col("doc_id")
    folder = d.pick(["resumes/", "transcripts/", "architecture/"], i)
    stem = d.pick(["Product_lead", "cloud-pm", "consulting", "master-career-file.md", "misc"],
                  F.floor(i / 3))
    files = d.table(spark, sf, "documents").select(
        "doc_id", stem.alias("filename"), F.concat(folder, stem).alias("path")
    )
    return docs.tag_documents(files)


def _profiles(spark, sf) -> DataFrame:
    return d.profiles(d.table(spark, sf, "customer"))


@query
def render_profile_text(spark, sf):
    return profiles.render_profile_text(_profiles(spark, sf))


@query
def render_patterns_text(spark, sf):
    return profiles.render_patterns_text(d.qa_documents(d.table(spark, sf, "documents")))


@query
def render_decisions_text(spark, sf):
    return profiles.render_decisions_text(d.decision_documents(d.table(spark, sf, "documents")))


@query
def anonymize_documents(spark, sf):
    return docs.anonymize_documents(
        _documents(spark, sf).select("doc_id", "text"), interviewers=d.INVENTED_INTERVIEWERS
    )


def _files(spark, sf) -> DataFrame:
    return docs.dealt(d.corpus_files(d.table(spark, sf, "documents")))


@query
def anonymize_filenames(spark, sf):
    files = _files(spark, sf).select("doc_id", "stem")
    return docs.anonymize_filenames(files, interviewers=d.INVENTED_INTERVIEWERS)


@query
def redact_pii(spark, sf):
    return docs.redact_pii(_documents(spark, sf).select("doc_id", "text"))


@query
def detect_pii(spark, sf):
    found = docs.detect_pii(_documents(spark, sf))
    return found.select("doc_id", F.array_join("pii_kinds", ", ").alias("pii_kinds"))


@query
def withhold_pii(spark, sf):
    return docs.withhold_pii(_documents(spark, sf).select("doc_id", "text"))


DENIED = ["# names", "", "deloitte", r"person@example\.com", "riot games?", "no such words"]


@query
def denylist_scan(spark, sf):
    hits = docs.denylist_scan(_files(spark, sf), DENIED)
    return hits.select("path", "line_no", "pattern")


@query
def denylist_scan_indexed(spark, sf):
    """The same among two thousand patterns that are in no file."""
    others = [rf"absent{i:04d}\s+words" for i in range(2000)]
    hits = pattern_index.denylist_scan_indexed(_files(spark, sf), [*DENIED, *others])
    return hits.select("path", "line_no", "pattern")


@query
def denylist_verdict(spark, sf):
    return docs.denylist_verdict(docs.denylist_scan(_files(spark, sf), DENIED))


@query
def corpus_scrub_report(spark, sf):
    report = docs.corpus_scrub_report(_files(spark, sf), interviewers=d.INVENTED_INTERVIEWERS)
    return report.select("doc_id", "output_name", "n_chars", "preview")


# -- retrieval -----------------------------------------------------------------


def _vectors(spark, sf) -> DataFrame:
    return d.table(spark, sf, "embeddings")


def _as_queries(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").alias("query_id"), "embedding")


def _tiers(spark, sf) -> DataFrame:
    return d.tier_vectors(_vectors(spark, sf))


def _questions(spark, sf) -> DataFrame:
    asked = d.questions(d.table(spark, sf, "conversations"))
    return d.embedded_questions(asked, _vectors(spark, sf))


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("distance", F.round("distance", 6))


@query
def embed_chunks(spark, sf):
    """Line chunks of all documents, encoded by hashed TF-IDF."""
    chunks = docs.chunk_lines(
        d.table(spark, sf, "documents").select(d.tier_of(F.col("doc_id")).alias("tier"),
                                               "doc_id", "text")
    )
    return retrieval.embed_chunks(chunks).select(
        "tier", "doc_id", "chunk_id", F.size("embedding").alias("dimensions")
    )


@query
def cosine_top_k(spark, sf):
    vectors = _vectors(spark, sf)
    return _rounded(retrieval.cosine_top_k(_as_queries(vectors), vectors, 3))


@query
def cosine_top_k_blocked(spark, sf):
    """The same over many small blocks."""
    vectors = _vectors(spark, sf)
    return _rounded(
        retrieval.cosine_top_k(_as_queries(vectors), vectors, 3, block_rows=128)
    )


@query
def ann_top_k(spark, sf):
    vectors = _vectors(spark, sf)
    return retrieval.ann_top_k(_as_queries(vectors), vectors, 3)


def _recall(spark, sf, search) -> DataFrame:
    vectors = _vectors(spark, sf)
    queries = _as_queries(vectors)
    near = search(queries, vectors, 3).select("query_id", "vec_id")
    exact = retrieval.cosine_top_k(queries, vectors, 3).select("query_id", "vec_id", F.lit(1).alias("wanted"))
    joined = exact.join(near.withColumn("found", F.lit(1)), ["query_id", "vec_id"], "full")
    return joined.agg(
        F.count_distinct("query_id").alias("queries"),
        (F.count_distinct(F.when(F.col("found") == 1, F.col("query_id"))) == F.count_distinct("query_id")).alias("all_answered"),
        (10 * F.count_if((F.col("wanted") == 1) & (F.col("found") == 1)) >= 9 * F.sum("wanted")).alias("recall_is_nine_tenths"),
    )


@query
def ann_top_k_recall(spark, sf):
    """The approximate search against the exact one: every query answered, nine in ten neighbours found."""
    return _recall(spark, sf, retrieval.ann_top_k)


@query
def indexed_top_k(spark, sf):
    """The exact search by cells and bounds."""
    vectors = _vectors(spark, sf)
    return _rounded(vector_index.indexed_search(_as_queries(vectors), vectors, 3))


@query
def probed_top_k_recall(spark, sf):
    """The search over codes against the exact one: every query answered, nine in ten neighbours found."""
    return _recall(spark, sf, vector_index.probed_search)


@query
def filtered_top_k(spark, sf):
    level = F.when(F.col("label") < 5, "public").otherwise("restricted")
    vectors = _vectors(spark, sf).withColumn("access_level", level)
    return _rounded(retrieval.filtered_top_k(_as_queries(vectors), vectors, "public", 5))


@query
def route_tiers(spark, sf):
    return retrieval.route_tiers(d.questions(d.table(spark, sf, "conversations")))


@query
def retrieve_tiers(spark, sf):
    return _results(spark, sf).select(
        "question_id",
        *[F.array_join(c, "|").alias(c)
          for c in ("resume_chunks", "interview_chunks", "arch_chunks", "used_tiers")],
        F.round("top_distance", 6).alias("top_distance"),
    )


@query
def retrieve_tiers_indexed(spark, sf):
    """The tiers searched by cells and bounds."""
    found = retrieval.retrieve_tiers(_questions(spark, sf), _tiers(spark, sf), search=vector_index.indexed_search)
    return found.select(
        "question_id",
        *[F.array_join(c, "|").alias(c)
          for c in ("resume_chunks", "interview_chunks", "arch_chunks", "used_tiers")],
        F.round("top_distance", 6).alias("top_distance"),
    )


@query
def weak_matches(spark, sf):
    return retrieval.weak_matches(_results(spark, sf), asked_at=_asked_at())


@query
def assemble_context(spark, sf):
    return retrieval.assemble_context(_results(spark, sf)).select("question_id", "context")


@query
def source_refs(spark, sf):
    return retrieval.source_refs(_results(spark, sf))


@query
def collection_stats(spark, sf):
    return retrieval.collection_stats(_tiers(spark, sf))


@query
def skill_match(spark, sf):
    matched = retrieval.skill_match(d.applications(d.table(spark, sf, "orders")))
    return matched.select(
        "application_id", "match_percentage", "job_description_preview",
        F.array_join("matching_skills", ",").alias("matching_skills"),
        F.array_join("missing_skills", ",").alias("missing_skills"),
    )


@query
def parse_analyses(spark, sf):
    """Match results as JSON answers, every fourth one broken, parsed again."""
    matched = retrieval.skill_match(d.applications(d.table(spark, sf, "orders")))
    answer = F.to_json(F.struct("match_percentage", "matching_skills"))
    broken = F.concat(F.lit("Sure: "), answer)
    answers = matched.select(
        "application_id",
        F.when(F.col("application_id") % 4 == 0, broken).otherwise(answer).alias("content"),
    )
    return retrieval.parse_analyses(answers, SKILL_ANALYSIS).select(
        "application_id",
        F.col("analysis.match_percentage").alias("match_percentage"),
        F.array_join("analysis.matching_skills", ",").alias("matching_skills"),
        "raw_response",
    )


# -- profiles and actions ------------------------------------------------------


@query
def experience_search(spark, sf):
    found = profiles.experience_search(_profiles(spark, sf), company="big four", after=2016)
    return found.select("profile_id", "position", "company", "dates")


@query
def skills_search_by_category(spark, sf):
    found = profiles.skills_search(_profiles(spark, sf), category="cloud_infrastructure")
    return found.select(
        "profile_id", F.explode("skills").alias("category", "items")
    ).select("profile_id", "category", F.array_join("items", ",").alias("skills"))


@query
def skills_search(spark, sf):
    found = profiles.skills_search(_profiles(spark, sf), keyword="sql")
    return found.select(
        "profile_id",
        F.array_join(F.map_keys("skills"), ",").alias("categories"),
        F.array_join(F.flatten(F.map_values("skills")), ",").alias("skills"),
    )


@query
def profile_sections(spark, sf):
    return profiles.profile_sections(_profiles(spark, sf), "education")


@query
def profile_certifications(spark, sf):
    return profiles.profile_sections(_profiles(spark, sf), "certifications")


@query
def profile_document(spark, sf):
    """The whole served document."""
    whole = profiles.profile_sections(_profiles(spark, sf), "all")
    return whole.select(
        "profile_id",
        F.array_join(F.transform("certifications", lambda c: c["name"]), "|").alias("certifications"),
        F.array_join(F.transform("education", lambda e: e["school"]), "|").alias("schools"),
        F.lit("portfolio_projects" in whole.columns).alias("has_projects"),
    )


@query
def action_validation(spark, sf):
    return profiles.action_validation(d.actions(d.table(spark, sf, "orders")))


# -- screening -----------------------------------------------------------------


def _turns(spark, sf) -> DataFrame:
    return d.probe_turns(d.table(spark, sf, "conversations"))


@query
def validate_questions(spark, sf):
    return screening.validate_questions(d.questions(d.table(spark, sf, "conversations")))


@query
def validate_conversations(spark, sf):
    return screening.validate_conversations(_turns(spark, sf))


@query
def detect_injection(spark, sf):
    return screening.detect_injection(_turns(spark, sf)).drop("text", "role")


@query
def suspicious_phrases(spark, sf):
    return screening.suspicious_phrases(_turns(spark, sf)).drop("text", "role")


def _requests(spark, sf) -> DataFrame:
    return d.screened_requests(d.table(spark, sf, "events"))


@query
def flagged_requests(spark, sf):
    return screening.flagged_requests(_requests(spark, sf), LONG_TTL)


@query
def flag_counts(spark, sf):
    return screening.flag_counts(_requests(spark, sf), LONG_TTL)


@query
def rate_limit(spark, sf):
    return screening.rate_limit(_requests(spark, sf), limit=2, window="1 day")


@query
def sender_rate_limit(spark, sf):
    """Ten messages an hour per sender."""
    messages = d.sender_messages(d.table(spark, sf, "conversations"))
    requests = messages.select(F.col("id").alias("query_id"), "sender", F.col("timestamp").alias("ts"))
    return screening.rate_limit(requests, limit=10, window="1 hour", key="sender")


@query
def recent_history(spark, sf):
    return screening.recent_history(_turns(spark, sf))


@query
def sender_history(spark, sf):
    return screening.sender_history(d.sender_messages(d.table(spark, sf, "conversations")))


@query
def first_contact(spark, sf):
    messages = d.sender_messages(d.table(spark, sf, "conversations"))
    return screening.first_contact(messages).select("id", "sender", "is_first_contact")


@query
def triage_mail(spark, sf):
    mail = d.mails(d.table(spark, sf, "documents"))
    return screening.triage_mail(mail, "bot@example.com").select("mail_id", "from", "threadId")


@query
def mail_to_question(spark, sf):
    mail = d.mails(d.table(spark, sf, "documents"))
    return screening.mail_to_question(mail).select("mail_id", "question")


@query
def budget_breaches(spark, sf):
    return screening.budget_breaches(d.budget_notices(d.table(spark, sf, "orders")))


# -- streams -------------------------------------------------------------------


def _event_stream(spark, sf) -> DataFrame:
    """The events as a stream. The file source lists folders only, unless the
    path is a glob; this one matches a single file as well as a folder."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")


def _paths(spark) -> tuple[str, str]:
    return scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")


@query
def stream_log_ingest(spark, sf):
    path, checkpoint = _paths(spark)
    log_streams.stream_log_ingest(d.raw_requests(_event_stream(spark, sf)), path, checkpoint).checked()
    return logs.read_access_log(spark, path).drop("created_at", "timestamp")


@query
def stream_sync(spark, sf):
    warehouse, checkpoint = _paths(spark)
    ledger = scratch_path(spark, "ledger")
    stream = d.live_log(_event_stream(spark, sf))
    _succeeded(log_streams.sync_stream(stream, warehouse, ledger, checkpoint))
    ids = spark.read.parquet(ledger).select("query_id")
    return sync.mark_synced(spark.read.parquet(warehouse), ids).drop("stream", "batch_id")


@query
def stream_hourly_traffic(spark, sf):
    path, checkpoint = _paths(spark)
    windows.stream_hourly_traffic(d.request_log(_event_stream(spark, sf)), path, checkpoint).checked()
    return windows.hourly_traffic_from(spark, path)


@query
def stream_rate_limit(spark, sf):
    path, checkpoint = _paths(spark)
    requests = d.screened_requests(_event_stream(spark, sf))
    windows.stream_rate_limit(requests, path, checkpoint, "1 day").checked()
    return windows.rate_limit_from(spark, path, limit=2)


@query
def stream_ip_flags(spark, sf):
    path, checkpoint = _paths(spark)
    requests = d.screened_requests(_event_stream(spark, sf))
    armed = scratch_path(spark, "armed")
    flag_streams.stream_ip_flags(requests, path, armed, checkpoint, LONG_TTL).checked()
    return flag_streams.verdicts_from(spark, path)


@query
def stream_session_depth(spark, sf):
    path, checkpoint = _paths(spark)
    windows.stream_session_depth(d.request_log(_event_stream(spark, sf)), path, checkpoint).checked()
    return windows.session_depth_from(spark, path)


@query
def stream_weak_matches(spark, sf):
    staged = scratch_path(spark, "results")
    results = _results(spark, sf).select(
        "question", "top_distance", _asked_at().alias("asked_at")
    )
    results.write.parquet(staged)
    stream = spark.readStream.schema(results.schema).parquet(staged)
    path, checkpoint = _paths(spark)
    log_streams.stream_weak_matches(stream, path, checkpoint).checked()
    return jsonl.read_jsonl_tolerant(spark, path)
