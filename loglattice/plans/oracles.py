"""The queries as plain SQL for DuckDB, written apart from the Spark code.

Only the fixed values (patterns, lists, texts) are shared with it.
"""

from __future__ import annotations

import re

from ..functions import fixed_values as fv
from . import derived as d


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def entry_of(values, index: str) -> str:
    return f"({arr(values)})[({index}) % {len(values)} + 1]"


def rounded(x: str, digits: int) -> str:
    """Half-up rounding of the decimal form of a double."""
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def avg_ms(column: str = "response_time_ms", digits: int = 2) -> str:
    return rounded(f"avg({column})", digits)


def pct(part: str, whole: str, digits: int) -> str:
    share = f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0) * 100"
    return rounded(f"({share})", digits)


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


SPACE = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", fv.SPACE_CLASS)


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def fold(x: str, rules, flags: str = "(?i)") -> str:
    for pattern, replacement in rules:
        x = f"regexp_replace({x}, {lit(flags + pattern)}, {lit(replacement)}, 'g')"
    return x


# RE2 knows ASCII word borders only. A marker of ASCII word characters around
# each run of other letters makes `\\b` fall where a Unicode one does.
OTHER_LETTERS = r"([^\x00-\x7F\pP\pS\pZ\pC]+)"


def marked(x: str) -> str:
    return f"regexp_replace({x}, {lit(OTHER_LETTERS)}, 'Zq9\\1Zq9', 'g')"


def unmarked(x: str) -> str:
    return f"replace({x}, 'Zq9', '')"


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {lit(w)})" for w in words) + ")"


# -- derived tables ------------------------------------------------------------

IS_SKILLS = f"{entry_of(fv.ENDPOINTS, 'k')} = {lit(fv.SKILLS_ENDPOINT)}"
SKILL = f"CASE WHEN {IS_SKILLS} THEN {entry_of(fv.SKILLS, 'k')} END"

LOG = f"""
base AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
log AS (
  SELECT event_id AS query_id, ts AS request_timestamp, 'GET' AS http_method,
    {entry_of(fv.ENDPOINTS, 'k')} AS endpoint_path,
    CASE WHEN {IS_SKILLS} THEN 'keyword=' || {entry_of(fv.SKILLS, 'k')} ELSE '' END AS query_params,
    {SKILL} AS skill_searched,
    {entry_of(fv.DOMAINS, 'user_id')} AS recruiter_domain,
    'agent/' || (user_id % 4) AS user_agent,
    '10.0.0.' || (user_id % 256) AS client_ip,
    CASE WHEN event_type = 'error' THEN 500 WHEN k < 5 THEN 404 ELSE 200 END AS http_status_code,
    value AS response_time_ms,
    'sess_' || user_id || '_' || strftime(ts, '%Y%m%d') AS session_id,
    {entry_of(d.CAMPAIGNS, 'user_id')} AS search_campaign,
    {entry_of(d.SOURCES, 'user_id // 5')} AS traffic_source,
    CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'engagement'
      WHEN 'purchase' THEN 'contact' END AS funnel_stage,
    {entry_of(d.DEVICES, 'user_id')} AS device_type,
    {entry_of(d.REGIONS, 'user_id // 3')} AS geo_region,
    CAST(ts AS DATE) AS date, k
  FROM base),
as_of AS (SELECT max(ts) AS t FROM events)"""


def log_query(sql: str) -> str:
    return f"WITH {LOG}\n{sql}"


def last(days: int = 0, hours: int = 0) -> str:
    return f"request_timestamp >= (SELECT t FROM as_of) - INTERVAL {days * 24 + hours} HOUR"


OK = "count(*) FILTER (http_status_code = 200)"
NOTE = lit(d.PHONE_NOTE)
KEY = "(conv_id * 7 + turn)"

TURNS = f"""
turns AS (
  SELECT conv_id, turn, role, text
    || CASE WHEN {KEY} % 11 = 0 THEN ' ' || {entry_of(d.PHRASES, 'conv_id + turn')} ELSE '' END
    || CASE WHEN {KEY} % 7 = 0 THEN ' ' || {entry_of(d.QUESTIONS, 'conv_id')} ELSE '' END
    || CASE WHEN {KEY} % 13 = 0 THEN {NOTE} ELSE '' END AS text
  FROM conversations),
questions AS (
  SELECT conv_id * 100 + turn AS question_id,
    CASE WHEN {KEY} % 17 = 0 THEN '   '
      WHEN {KEY} % 5 = 0 THEN '  ' || {entry_of(d.QUESTIONS, KEY)} || ' '
      ELSE text END AS question
  FROM turns)"""

DOCS = f"""
docs AS (
  SELECT doc_id, source, lang, text
    || CASE WHEN doc_id % 13 = 0 THEN {NOTE} ELSE '' END
    || CASE WHEN doc_id % 11 = 0 THEN {lit(d.WORK_NOTE)} ELSE '' END AS text
  FROM documents),
files AS (
  SELECT doc_id, source, {entry_of(d.FILE_STEMS, 'doc_id')} AS stem,
    {entry_of(['corpus', 'tests', 'docs'], 'doc_id // 4')} AS folder,
    {entry_of(['.txt', '.md', '.py', '.pyc'], 'doc_id')} AS ext, text
  FROM docs)"""

HISTORIC = f"""{LOG},
historic AS (
  SELECT query_id, request_timestamp AS timestamp, recruiter_domain, endpoint_path AS endpoint_hit,
    skill_searched, CAST(floor(response_time_ms) AS INTEGER) AS response_time_ms,
    http_status_code AS http_status, user_agent, 'https://' || recruiter_domain AS referer_url
  FROM log)"""

ORACLES: dict[str, str] = {}
add = ORACLES.__setitem__

# -- log reports ---------------------------------------------------------------

HITS = "SELECT recruiter_domain, count(*) AS total_hits FROM log {where} GROUP BY 1"
add("domain_hits", log_query(HITS.format(where="")))
TOP = HITS + " ORDER BY 2 DESC, 1 LIMIT 1"
add("top_domain", log_query(TOP.format(where="")))
add("top_domain_recent", log_query(TOP.format(where=f"WHERE {last(days=10)}")))
add("distinct_domains", log_query(
    "SELECT count(DISTINCT recruiter_domain) AS distinct_domains FROM log"))


def scorecard(rows: str, known_only: bool = False) -> str:
    known = "WHERE skill_searched IS NOT NULL" if known_only else ""
    return f"""
rows AS ({rows}),
stats AS (
  SELECT recruiter_domain, count(*) AS total_hits, {OK} AS successful_hits,
    {avg_ms()} AS avg_response_ms, min(request_timestamp) AS first_visit,
    max(request_timestamp) AS last_visit
  FROM rows GROUP BY 1),
skills AS (
  SELECT recruiter_domain, skill_searched, row_number() OVER (
    PARTITION BY recruiter_domain ORDER BY count(*) DESC, skill_searched ASC NULLS LAST) AS n
  FROM rows {known} GROUP BY 1, 2),
ranked AS (SELECT *, rank() OVER (ORDER BY total_hits DESC) AS activity_rank FROM stats)
SELECT r.recruiter_domain, total_hits, successful_hits, avg_response_ms,
  skill_searched AS top_skill_searched, first_visit, last_visit,
  CAST(activity_rank AS INTEGER) AS activity_rank,
  {pct('successful_hits', 'total_hits', 1)} AS success_rate_pct,
  CAST(date_diff('day', CAST(first_visit AS DATE), CAST(last_visit AS DATE)) AS INTEGER)
    AS engagement_span_days
FROM ranked r LEFT JOIN skills s ON s.recruiter_domain = r.recruiter_domain AND s.n = 1
WHERE activity_rank <= 10"""


RECENT_90 = f"SELECT * FROM log WHERE {last(days=90)}"
add("domain_scorecard", f"WITH {LOG}, {scorecard(RECENT_90)}")
add("domain_scorecard_known_skills", f"WITH {LOG}, {scorecard(RECENT_90, True)}")
add("domain_rank_first", log_query(f"""
SELECT * FROM (
  SELECT recruiter_domain, count(*) AS total_hits, {OK} AS successful_hits,
    {avg_ms()} AS avg_response_ms,
    CAST(rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS activity_rank,
    {pct(OK, 'count(*)', 1)} AS success_rate_pct
  FROM log GROUP BY 1) WHERE activity_rank = 1"""))


def endpoint_window(from_days: int, to_days: int) -> str:
    return log_query(f"""
SELECT recruiter_domain, endpoint_path, count(*) AS hits,
  quantile_disc(response_time_ms, 0.95) AS p95_response_ms,
  quantile_disc(response_time_ms, 0.5) AS p50_response_ms
FROM log, as_of
WHERE date BETWEEN CAST(t - INTERVAL {from_days} DAY AS DATE) AND CAST(t - INTERVAL {to_days} DAY AS DATE)
  AND recruiter_domain IN ('google.com', 'amazon.com')
GROUP BY 1, 2""")


add("endpoint_quantiles", endpoint_window(20, 5))
add("endpoint_quantiles_by_day", endpoint_window(12, 3))
add("recent_top_domains", log_query(f"""
SELECT recruiter_domain, count(*) AS total_hits, {avg_ms()} AS avg_response_ms,
  {OK} AS successful_hits, {pct(OK, 'count(*)', 1)} AS success_rate_pct
FROM log WHERE {last(hours=24)} GROUP BY 1 ORDER BY total_hits DESC, 1 LIMIT 10"""))


def hourly(where: str) -> str:
    return log_query(f"""
SELECT CAST(hour(request_timestamp) AS INTEGER) AS hour_of_day, count(*) AS requests,
  {avg_ms()} AS avg_latency_ms
FROM log {where} GROUP BY 1""")


add("hourly_traffic", hourly(f"WHERE {last(days=7)}"))
add("endpoint_popularity", log_query(f"""
SELECT endpoint_path, count(*) AS hits, {avg_ms()} AS avg_latency_ms,
  quantile_disc(response_time_ms, 0.95) AS p95_latency_ms
FROM log WHERE {last(days=7)} GROUP BY 1"""))
# -- daily summaries: exact figures of whole days; every bound must hold

DAYS = "date > CAST((SELECT max(date) FROM log) - INTERVAL {n} DAY AS DATE)"
WEEK = DAYS.format(n=7)
DROPOFF = {
    "sessions": "true", "step_1_impressions": "i", "step_2_engagements": "e", "step_3_contacts": "c",
    "engaged": "i AND e", "completed": "i AND e AND c", "lost_after_impression": "i AND NOT e",
    "lost_after_engagement": "i AND e AND NOT c",
}
add("funnel_dropoff_sketched", f"""WITH {LOG}, f AS (
  SELECT bool_or(funnel_stage = 'impression') AS i, bool_or(funnel_stage = 'engagement') AS e, bool_or(funnel_stage = 'contact') AS c
  FROM log WHERE funnel_stage IS NOT NULL AND session_id IS NOT NULL AND {WEEK} GROUP BY session_id)
""" + " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) FILTER ({e}) AS exact, true AS within_bound FROM f" for m, e in DROPOFF.items()))
add("funnel_by_campaign_sketched", log_query(f"""
SELECT search_campaign, count(*) AS total_sessions, count(*) FILTER (i) AS impressions,
  count(*) FILTER (e) AS engagements, count(*) FILTER (c) AS contacts, true AS within_bound
FROM (SELECT search_campaign, bool_or(funnel_stage = 'impression') AS i, bool_or(funnel_stage = 'engagement') AS e,
        bool_or(funnel_stage = 'contact') AS c
      FROM log WHERE funnel_stage IS NOT NULL AND {WEEK} GROUP BY session_id, search_campaign, traffic_source)
GROUP BY 1"""))
add("endpoint_quantiles_sketched", f"""
SELECT recruiter_domain, endpoint_path, hits, true AS p95_response_ms_within_bound, true AS p50_response_ms_within_bound
FROM ({endpoint_window(20, 5)})""")
add("endpoint_popularity_sketched", log_query(f"""
SELECT endpoint_path, count(*) AS hits, {avg_ms()} AS avg_latency_ms, true AS p95_latency_ms_within_bound
FROM log WHERE {WEEK} GROUP BY 1"""))
add("latency_percentiles_sketched", log_query("""
SELECT count(*) > 0 AS p50_within_bound, true AS p95_within_bound, true AS p99_within_bound FROM log"""))
add("domain_skills_sketched", log_query("""
SELECT recruiter_domain, count(*) AS hits, true AS bounds_hold, true AS frequent_found, true AS missing_within_bound
FROM log GROUP BY 1"""))
add("distinct_domains_approx", log_query(
    "SELECT count(DISTINCT recruiter_domain) AS distinct_domains, true AS within_bound FROM log"))
HEALTH = """
SELECT date AS sync_date, count(*) AS records, min(request_timestamp) AS earliest,
  max(request_timestamp) AS latest, count(DISTINCT recruiter_domain) AS unique_domains
FROM log GROUP BY 1 ORDER BY 1 DESC LIMIT 7"""
add("load_health", log_query(HEALTH))
LEDGER = """ledger AS (
  SELECT event_id AS query_id, TIMESTAMP '2024-02-01 00:00:00' + to_seconds(event_id % 7) AS synced_at
  FROM events WHERE event_id % 3 <> 0)"""
add("last_sync_status", f"""WITH {LOG}, {LEDGER}
SELECT sync_date, records, (SELECT max(synced_at) FROM ledger) AS last_synced_at
FROM ({HEALTH})""")
add("skill_searches", log_query(f"""
SELECT nullif(regexp_extract(query_params, {lit(fv.KEYWORD_PARAM)}, 1), '') AS skill_searched,
  count(*) AS search_count, count(DISTINCT recruiter_domain) AS unique_recruiters
FROM log
WHERE endpoint_path = '/resume/skills' AND query_params LIKE '%keyword%' AND {last(days=30)}
GROUP BY 1"""))

STAGED = f"funnel_stage IS NOT NULL AND {last(days=7)}"


def had(stage: str) -> str:
    return f"max(CASE WHEN funnel_stage = '{stage}' THEN 1 ELSE 0 END)"


add("funnel_by_campaign", log_query(f"""
SELECT search_campaign, count(*) AS total_sessions, {big('sum(i)')} AS impressions,
  {big('sum(e)')} AS engagements, {big('sum(c)')} AS contacts,
  {pct('sum(e)', 'sum(i)', 2)} AS engagement_rate_pct,
  {pct('sum(c)', 'sum(i)', 2)} AS conversion_rate_pct
FROM (
  SELECT session_id, search_campaign, traffic_source, {had('impression')} AS i,
    {had('engagement')} AS e, {had('contact')} AS c
  FROM log WHERE {STAGED} GROUP BY 1, 2, 3)
GROUP BY 1"""))
add("funnel_dropoff", log_query(f"""
SELECT s1 AS step_1_impressions, s2 AS step_2_engagements, s3 AS step_3_contacts,
  {pct('s2', 's1', 1)} AS impression_to_engagement_pct,
  {pct('s3', 's2', 1)} AS engagement_to_contact_pct,
  {pct('s3', 's1', 1)} AS overall_conversion_pct,
  s1 - s2 AS dropped_after_impression, s2 - s3 AS dropped_after_engagement
FROM (
  SELECT count(DISTINCT CASE WHEN funnel_stage = 'impression' THEN session_id END) AS s1,
    count(DISTINCT CASE WHEN funnel_stage = 'engagement' THEN session_id END) AS s2,
    count(DISTINCT CASE WHEN funnel_stage = 'contact' THEN session_id END) AS s3
  FROM log WHERE {STAGED})"""))
add("conversion_by_source", log_query(f"""
SELECT traffic_source, count(*) AS total_sessions, {big('sum(c)')} AS conversions,
  {pct('sum(c)', 'count(*)', 2)} AS conversion_rate_pct,
  CAST(rank() OVER (ORDER BY CAST(sum(c) AS DOUBLE) / count(*) DESC) AS INTEGER) AS source_rank
FROM (
  SELECT session_id, traffic_source, {had('contact')} AS c
  FROM log WHERE funnel_stage IS NOT NULL AND {last(days=30)} GROUP BY 1, 2)
GROUP BY 1"""))


def staged_count(stage: str) -> str:
    return f"count(*) FILTER (funnel_stage = '{stage}')"


add("campaign_device_region", log_query(f"""
SELECT search_campaign, device_type, geo_region, count(DISTINCT session_id) AS sessions,
  count(*) AS total_events, {staged_count('impression')} AS impressions,
  {staged_count('engagement')} AS engagements, {staged_count('contact')} AS contacts,
  {avg_ms()} AS avg_latency_ms,
  {pct(staged_count('contact'), staged_count('impression'), 2)} AS cvr_pct
FROM log WHERE {STAGED} GROUP BY 1, 2, 3
HAVING {staged_count('impression')} > 0"""))


def depth(where: str) -> str:
    return log_query(f"""
SELECT search_campaign, {rounded('avg(sections)', 1)} AS avg_sections_viewed,
  {rounded('(CAST(sum(us) AS DOUBLE) / count(*) / 1000000)', 1)} AS avg_session_duration_sec,
  {rounded('avg(sections) FILTER (c = 1)', 1)} AS avg_sections_converters,
  {rounded('avg(sections) FILTER (c = 0)', 1)} AS avg_sections_non_converters
FROM (
  SELECT session_id, search_campaign, count(DISTINCT endpoint_path) AS sections,
    {had('contact')} AS c,
    epoch_us(max(request_timestamp)) - epoch_us(min(request_timestamp)) AS us
  FROM log WHERE {where} GROUP BY 1, 2)
GROUP BY 1""")


add("session_depth", depth(STAGED))
add("funnel_stage_counts", log_query("""
SELECT funnel_stage, count(*) AS events, count(DISTINCT session_id) AS sessions
FROM log WHERE funnel_stage IS NOT NULL GROUP BY 1"""))
add("log_extent", log_query("""
SELECT count(*) AS "rows", min(request_timestamp) AS "first", max(request_timestamp) AS "last"
FROM log"""))
add("campaign_event_counts", log_query("""
SELECT search_campaign, count(*) AS events FROM log
WHERE search_campaign IS NOT NULL GROUP BY 1"""))

# -- log API -------------------------------------------------------------------

ISO = """strftime(request_timestamp, '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN epoch_us(request_timestamp) % 1000000 = 0 THEN ''
       ELSE strftime(request_timestamp, '.%f') END || '+00:00'"""
PAGE = f"""
SELECT query_id AS id, {ISO} AS timestamp, recruiter_domain AS domain, endpoint_path AS path,
  'N/A' AS client_ip
FROM log {{where}} ORDER BY request_timestamp DESC, query_id DESC LIMIT {{limit}} OFFSET {{offset}}"""
add("query_log_page", log_query(PAGE.format(where="", limit=50, offset=0)))
add("query_log_page_of_domain", log_query(
    PAGE.format(where="WHERE recruiter_domain = 'google.com'", limit=20, offset=5)))
add("query_log_page_deep", log_query(PAGE.format(where="", limit=50, offset=700)))
add("top_domains_map", log_query("""
SELECT recruiter_domain AS domain, count(*) AS hits FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
add("top_domains", log_query("""
SELECT recruiter_domain AS domain, count(*) AS hits FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
add("latency_percentiles", log_query("SELECT " + ", ".join(
    f"quantile_disc(response_time_ms, 0.{p}) AS p{p}" for p in (50, 95, 99)) + " FROM log"))
add("distinct_values", log_query("SELECT DISTINCT client_ip AS value FROM log ORDER BY 1 LIMIT 5"))
add("distinct_campaigns", log_query(
    "SELECT DISTINCT search_campaign AS value FROM log ORDER BY 1 LIMIT 5"))

# -- sources and sinks ---------------------------------------------------------

FUNNEL = ", ".join(fv.FUNNEL_HEADERS)
LIVE = f"""
SELECT query_id, http_method AS method, endpoint_path AS path, query_params, recruiter_domain,
  user_agent, client_ip, http_status_code AS status_code, response_time_ms, {FUNNEL}
FROM log"""
add("read_access_log", log_query(LIVE))
add("append_log_stream", log_query(LIVE))
HISTORIC_ROWS = "SELECT * FROM historic"
add("write_csv_log", f"WITH {HISTORIC} {HISTORIC_ROWS}")
add("read_csv_log_rows", f"WITH {HISTORIC} {HISTORIC_ROWS}")
add("read_csv_log", f"WITH {HISTORIC}, " + scorecard("""
  SELECT recruiter_domain, timestamp AS request_timestamp, http_status AS http_status_code,
    response_time_ms, skill_searched
  FROM historic
  WHERE timestamp >= (SELECT max(timestamp) FROM historic) - INTERVAL 2160 HOUR"""))
add("read_jsonl_tolerant", """
SELECT '2024-01-01T00:00:00+00:00' AS ts, 'question ' || conv_id || '/' || turn AS question,
  turn * CAST(0.125 AS DOUBLE) AS top_distance, turn > 5 AS low_confidence
FROM conversations WHERE (conv_id + turn) % 5 <> 0 AND (conv_id + turn) % 7 <> 0""")
add("read_text_corpus", f"""
SELECT lang, {big('sum(length(text) + 1)')} AS n_chars FROM documents GROUP BY 1""")
add("read_text_corpus_lines", """
SELECT lang, md5(line) AS digest, count(*) AS n
FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1, 2""")
add("write_partitioned", log_query("""
SELECT date, recruiter_domain, count(*) AS hits, min(query_id) AS first_id FROM log GROUP BY 1, 2"""))
add("replicate_rows", log_query("""
SELECT recruiter_domain, count(*) * 10 AS hits, count(*) * 10 AS ids,
  max(query_id) * 10 + 9 AS last_id
FROM log GROUP BY 1"""))
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
add("table_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS \"rows\" FROM {t}" for t in TABLES))

# -- incremental sync ----------------------------------------------------------

add("derive_referer_domain", r"""
SELECT page_id, url AS referer_url, CASE WHEN n = '' THEN 'direct'
  WHEN contains(n, '[') <> contains(n, ']') THEN 'parsing_error' ELSE n END AS recruiter_domain
FROM (SELECT *, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS n FROM pages)""")
SERVED = f"""
SELECT query_id, http_method AS method, endpoint_path AS path, query_params,
  CASE WHEN query_id % 5 < 2 THEN 'direct' ELSE recruiter_domain END AS recruiter_domain,
  user_agent, client_ip, http_status_code AS status_code, response_time_ms, {FUNNEL}
FROM log"""
add("enrich_requests", log_query(SERVED))
add("stream_log_ingest", log_query(SERVED))
add("unsynced_batch", f"""WITH {LOG}, {LEDGER}
SELECT query_id, endpoint_path AS path, recruiter_domain FROM log
WHERE query_id NOT IN (SELECT query_id FROM ledger) ORDER BY query_id LIMIT 10000""")
add("to_warehouse", log_query(f"""
SELECT query_id, request_timestamp, http_method, endpoint_path, query_params, recruiter_domain,
  user_agent, client_ip, http_status_code, response_time_ms, {FUNNEL},
  CAST(hour(request_timestamp) AS INTEGER) AS hour_of_day,
  dayname(request_timestamp) AS day_of_week, date
FROM log"""))
PER_DAY = 'SELECT date, count(*) AS "rows", count(DISTINCT query_id) AS ids'
add("append_warehouse", log_query(f"{PER_DAY} FROM log GROUP BY 1"))
add("append_warehouse_rows", ORACLES["to_warehouse"])
for name in ("run_sync", "stream_sync"):
    add(name, log_query(f"""
SELECT query_id, request_timestamp, http_method, endpoint_path, query_params, recruiter_domain,
  user_agent, client_ip, http_status_code, response_time_ms, request_timestamp AS created_at, {FUNNEL},
  CAST(hour(request_timestamp) AS INTEGER) AS hour_of_day,
  dayname(request_timestamp) AS day_of_week, date, 1 AS synced
FROM log"""))
add("mark_synced", f"""WITH {LOG}, {LEDGER}
SELECT query_id, recruiter_domain,
  CASE WHEN query_id IN (SELECT query_id FROM ledger) THEN 1 ELSE 0 END AS synced
FROM log""")
add("sync_status", f"""WITH {LEDGER}
SELECT t AS total, s AS synced, t - s AS pending
FROM (SELECT (SELECT count(*) FROM events) AS t, (SELECT count(*) FROM ledger) AS s)""")

add("write_clustered", log_query("SELECT query_id, date, recruiter_domain, endpoint_path, response_time_ms FROM log"))
# The bitmap ledger gives what the list of ids gives.
for name in ("unsynced_batch", "mark_synced", "sync_status"):
    add(f"{name}_bitmap", ORACLES[name])
add("run_sync_table", ORACLES["run_sync"])

# -- documents -----------------------------------------------------------------



def line_chunks(docs: str) -> str:
    """Line by line: the open chunk is the span s..e; cs..ce is one just closed."""
    return f"""
split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {docs}),
lines AS (
  SELECT doc_id, i, sum(length(parts[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS stop
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM split)),
walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e,
    CAST(NULL AS BIGINT) AS cs, CAST(NULL AS BIGINT) AS ce
  FROM {docs}
  UNION ALL
  SELECT w.doc_id, l.i, CASE WHEN e > s AND stop - s > 500 THEN greatest(s, e - 50) ELSE s END,
    CAST(stop AS BIGINT), CASE WHEN e > s AND stop - s > 500 THEN s END,
    CASE WHEN e > s AND stop - s > 500 THEN e END
  FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.i = w.i + 1),
ends AS (SELECT doc_id, max(i) AS i FROM walk GROUP BY 1),
spans AS (
  SELECT doc_id, i, cs, ce, false AS is_last FROM walk WHERE cs IS NOT NULL
  UNION ALL
  SELECT w.doc_id, w.i + 1, s, e, true FROM walk w JOIN ends USING (doc_id, i)),
stripped AS (
  SELECT doc_id, i, is_last, {strip("substr(text || chr(10), cs + 1, ce - cs)")} AS text
  FROM spans JOIN {docs} USING (doc_id)),
line_chunks AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER)
    AS chunk_index, text
  FROM stripped WHERE NOT (is_last AND text = ''))"""


add("chunk_lines", f"WITH RECURSIVE {DOCS}, {line_chunks('docs')} SELECT * FROM line_chunks")
add("chunk_words", f"""WITH {DOCS},
split AS (
  SELECT doc_id, source, list_filter(regexp_split_to_array(text, {lit(SPACE + '+')}), lambda w: w <> '') AS w
  FROM docs),
starts AS (
  SELECT *, unnest(range(0, len(w), 338)) AS s, CAST(ceil(len(w) / 338.0) AS INTEGER) AS total_chunks
  FROM split)
SELECT doc_id, source, CAST(s // 338 AS INTEGER) AS chunk_index, total_chunks,
  array_to_string(w[s + 1 : s + 375], ' ') AS text
FROM starts""")
STEMS = ["Product_lead", "cloud-pm", "consulting", "master-career-file.md", "misc"]
add("tag_documents", f"""
WITH f AS (
  SELECT doc_id, {entry_of(STEMS, 'doc_id // 3')} AS filename,
    {entry_of(['resumes/', 'transcripts/', 'architecture/'], 'doc_id')} AS folder
  FROM documents),
t AS (
  SELECT doc_id, filename, folder || filename AS path,
    CASE folder WHEN 'transcripts/' THEN 'transcript' WHEN 'architecture/' THEN 'architecture'
      ELSE CASE WHEN filename = 'master-career-file.md' THEN 'career' ELSE 'resume' END END AS type
  FROM f)
SELECT *, CASE WHEN type IN ('transcript', 'architecture') THEN 'public' ELSE 'restricted' END
    AS access_level,
  CASE WHEN type <> 'resume' THEN 'general' WHEN filename = 'Product_lead' THEN 'product'
    WHEN filename = 'cloud-pm' THEN 'pm' WHEN filename = 'consulting' THEN 'consulting'
    ELSE 'general' END AS role_tag
FROM t""")

_k = "c_custkey"


def _title(skill_index: int) -> str:
    return entry_of(fv.SKILLS, f"{_k} + {skill_index}")


def _job(shift: int) -> str:
    return (
        f"'# ' || {entry_of(d.PROFILE_COMPANIES, f'{_k} + {shift}')} || ' — Engineer {shift} (' || "
        f"{entry_of(d.PROFILE_DATES, f'{_k} + {shift}')} || ')\n\n## Project ' || ({_k} % 9) || "
        f"': Delivery\n- built it\n- ' || {_title(shift)}"
    )


add("render_profile_text", f"""
SELECT c_custkey AS profile_id, array_to_string([
  '# Professional Summary\nSummary of ' || c_name,
  '# Skills\n\n## Technical Development\n- ' || {_title(0)} || '\n- ' || {_title(3)}
    || '\n- Git\n## Cloud Infrastructure\n- ' || {_title(5)},
  {_job(0)},
  {_job(1)},
  '# Education\nBSc in Major ' || (c_custkey % 4) || ', State College',
  '# Certifications\n- Cert ' || (c_custkey % 6) || '\n- Cert X',
  '# Portfolio Projects\n\n## Demo ' || (c_custkey % 5) || '\nA small tool\n'
], '\n\n') AS text
FROM customer""")
ITEM_LINES = """
WITH l AS (
  SELECT doc_id, lang, source, parts, unnest(range(1, len(parts) + 1)) AS i
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents))"""
add("render_patterns_text", f"""{ITEM_LINES}
SELECT doc_id, string_agg('INTERVIEW PATTERN — Question ' || i || '\nTags: ' || lang || ', ' || source
  || '\nResponse pattern: ' || parts[i] || '\n', '\n---\n' ORDER BY i) AS text
FROM l GROUP BY 1""")
add("render_decisions_text", f"""{ITEM_LINES}
SELECT doc_id, string_agg('ARCHITECTURE DECISION — Decision ' || i || '\nPhase: '
  || CASE WHEN (i - 1) % 2 = 0 THEN CAST((i - 1) % 8 AS VARCHAR) ELSE 'n/a' END || '\n'
  || parts[i] || '\n', '\n---\n' ORDER BY i) AS text
FROM l GROUP BY 1""")

PEOPLE = [(rf"\b{n}\b", fv.INTERVIEWER_LABEL) for n in d.INVENTED_INTERVIEWERS]


def clean_text(x: str) -> str:
    x = unmarked(fold(marked(x), [*fv.DOCUMENT_PII_RULES, *fv.ORGANISATION_RULES, *PEOPLE]))
    x = fold(x, [(fv.CREDIT_LINE_ANY_CASE, "")], "(?im-s)")
    x = fold(x, [(fv.CREDIT_LINE_AS_WRITTEN, "")], "(?m-s)")
    return strip(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def clean_name(x: str) -> str:
    gone = [(p.replace(r"\b", "").replace("?", ""), "") for p, _ in fv.ORGANISATION_RULES]
    gone += [(n, "") for n in d.INVENTED_INTERVIEWERS] + [(fv.FILENAME_SUFFIX, "")]
    x = fold(fold(x, gone), [(fv.FILENAME_COPY_NUMBER, "")], "")
    x = f"trim(regexp_replace({x}, '[_\\s]+', '_', 'g'), '_')"
    return f"coalesce(nullif({x}, ''), {lit(fv.EMPTY_FILENAME)})"


add("anonymize_documents", f"WITH {DOCS} SELECT doc_id, {clean_text('text')} AS text FROM docs")
add("anonymize_filenames",
    f"WITH {DOCS} SELECT doc_id, stem, {clean_name('stem')} AS clean_name FROM files")
add("corpus_scrub_report", f"""WITH {DOCS},
c AS (SELECT doc_id, {clean_name('stem')} || '.md' AS output_name, {clean_text('text')} AS t FROM files)
SELECT doc_id, output_name, CAST(length(t) AS INTEGER) AS n_chars, substr(t, 1, 500) AS preview FROM c""")
add("redact_pii",
    f"WITH {DOCS} SELECT doc_id, {unmarked(fold(marked('text'), fv.ANSWER_PII_RULES, ''))} AS text FROM docs")
KINDS = ", ".join(
    f"CASE WHEN regexp_matches({marked('text')}, {lit(p)}) THEN {lit(kind)} END" for p, kind in fv.PII_KINDS)
add("detect_pii", f"WITH {DOCS} SELECT doc_id, concat_ws(', ', {KINDS}) AS pii_kinds FROM docs")
ANY_KIND = " OR ".join(f"regexp_matches({marked('text')}, {lit(p)})" for p, _ in fv.PII_KINDS)
add("withhold_pii", f"""WITH {DOCS}
SELECT doc_id, CASE WHEN {ANY_KIND} THEN {lit(fv.WITHHELD_MESSAGE)} ELSE text END AS text FROM docs""")
HITS_OF_SCAN = f"""{DOCS},
l AS (
  SELECT folder || '/' || source || '/' || stem || '_' || doc_id || ext AS path, parts,
    unnest(range(1, len(parts) + 1)) AS i
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM files
        WHERE ext IN ('.txt', '.md', '.py') AND folder <> 'tests')),
p AS (SELECT unnest({arr(['deloitte', r'person@example\.com', 'riot games?', 'no such words'])}) AS pattern),
hits AS (
  SELECT path, CAST(i AS INTEGER) AS line_no, pattern FROM l, p
  WHERE regexp_matches(parts[i], '(?i)' || pattern))"""
add("denylist_scan", f"WITH {HITS_OF_SCAN} SELECT * FROM hits")
add("denylist_scan_indexed", ORACLES["denylist_scan"])
add("denylist_verdict", f"WITH {HITS_OF_SCAN} SELECT count(*) AS hits, count(*) = 0 AS passed FROM hits")

# -- retrieval -----------------------------------------------------------------

# the ids and sizes; what the vectors hold has no SQL form
add("embed_chunks", f"""WITH RECURSIVE {line_chunks('documents')}
SELECT (['resume', 'interview', 'architecture'])[doc_id % 3 + 1] AS tier, doc_id,
  (['chunk', 'iv', 'arch'])[doc_id % 3 + 1] || '_' || doc_id || '_' || chunk_index AS chunk_id, 256 AS dimensions
FROM line_chunks""")
DISTANCE = ("(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), "
            "CAST(v.embedding AS DOUBLE[])))")


def nearest(k: int, where: str = "true") -> str:
    return f"""
SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(n AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS n FROM (
    SELECT q.vec_id AS query_id, v.vec_id, {DISTANCE} AS distance
    FROM embeddings q, embeddings v WHERE {where}))
WHERE n <= {k}"""


add("cosine_top_k", nearest(3))
add("cosine_top_k_blocked", nearest(3))
add("filtered_top_k", nearest(5, "v.label < 5"))
add("ann_top_k_recall", """
SELECT count(DISTINCT vec_id) AS queries, true AS all_answered, true AS recall_is_nine_tenths FROM embeddings""")
BEHAVIOURAL = contains_any("question", fv.BEHAVIOURAL_KEYWORDS)
ARCHITECTURE = contains_any("question", fv.ARCHITECTURE_KEYWORDS)
add("route_tiers", f"""WITH {TURNS}
SELECT question_id, question, {BEHAVIOURAL} AS needs_interview, {ARCHITECTURE} AS needs_architecture
FROM questions""")
RESULTS = f"""{TURNS},
chunks AS (
  SELECT (['resume', 'interview', 'architecture'])[label % 3 + 1] AS tier, vec_id,
    'chunk text ' || vec_id AS text, embedding
  FROM embeddings),
asked AS (
  SELECT question_id, question, embedding, unnest(list_filter([
    'resume', CASE WHEN {BEHAVIOURAL} THEN 'interview' END,
    CASE WHEN {ARCHITECTURE} THEN 'architecture' END], lambda t: t IS NOT NULL)) AS tier
  FROM questions JOIN embeddings
    ON vec_id = question_id % (SELECT count(*) FROM embeddings)),
found AS (
  SELECT *, row_number() OVER (PARTITION BY question_id, tier ORDER BY distance, vec_id) AS n FROM (
    SELECT question_id, question, q.tier, v.vec_id, v.text, {DISTANCE} AS distance
    FROM asked q JOIN chunks v ON v.tier = q.tier)),
top AS (SELECT * FROM found WHERE n <= 3)"""


def of_tier(tier: str, separator: str) -> str:
    return (f"coalesce(string_agg(text, {lit(separator)} ORDER BY n) FILTER (tier = '{tier}'), '')")


add("retrieve_tiers", f"""WITH {RESULTS}
SELECT question_id, {of_tier('resume', '|')} AS resume_chunks,
  {of_tier('interview', '|')} AS interview_chunks, {of_tier('architecture', '|')} AS arch_chunks,
  'resume' || CASE WHEN bool_or(tier = 'interview') THEN '|interview' ELSE '' END
    || CASE WHEN bool_or(tier = 'architecture') THEN '|architecture' ELSE '' END AS used_tiers,
  round(coalesce(min(distance) FILTER (tier = 'resume'), 1.0), 6) AS top_distance
FROM top GROUP BY 1""")
WEAK = f"""WITH {RESULTS}
SELECT strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(question_id), '%Y-%m-%dT%H:%M:%S+00:00') AS ts,
  substr(question, 1, 300) AS question, {rounded('distance', 4)} AS top_distance,
  true AS low_confidence
FROM top WHERE tier = 'resume' AND n = 1 AND distance > 0.7"""
for _name in ("weak_matches", "write_jsonl", "stream_weak_matches"):
    add(_name, WEAK)
SEP = fv.CHUNK_SEPARATOR
add("assemble_context", f"""WITH {RESULTS}
SELECT question_id, {lit(fv.CONTEXT_HEADINGS['resume'])} || '\n\n' || {of_tier('resume', SEP)}
  || CASE WHEN bool_or(tier = 'interview') THEN '\n\n' || {lit(fv.CONTEXT_HEADINGS['interview'])}
     || '\n\n' || {of_tier('interview', SEP)} ELSE '' END
  || CASE WHEN bool_or(tier = 'architecture') THEN '\n\n' || {lit(fv.CONTEXT_HEADINGS['architecture'])}
     || '\n\n' || {of_tier('architecture', SEP)} ELSE '' END AS context
FROM top GROUP BY 1""")
add("source_refs", f"""WITH {RESULTS}
SELECT question_id, CAST(n - 1 AS INTEGER) AS position, substr(text, 1, 200) AS chunk,
  {rounded('(1.0 - (n - 1) * 0.1)', 2)} AS relevance
FROM top WHERE tier = 'resume'""")
add("collection_stats", """
SELECT (['resume', 'interview', 'architecture'])[label % 3 + 1] AS tier, count(*) AS chunks
FROM embeddings GROUP BY 1""")


def three(key: str) -> str:
    return "[" + ", ".join(entry_of(d.SKILL_TERMS, f"{key} + {s}") for s in (0, 4, 7)) + "]"


APPLICATIONS = f"""
a AS (
  SELECT o_orderkey AS application_id, {three('o_custkey')} AS held,
    CASE WHEN o_orderkey % 9 = 0 THEN CAST([] AS VARCHAR[]) ELSE {three('o_orderkey')} END AS wanted,
    'We look for someone who knows ' || o_orderpriority || repeat(' and more', o_orderkey % 30) AS text
  FROM orders),
m AS (
  SELECT *, list_filter(wanted, lambda s: list_contains(held, s)) AS matching,
    list_filter(wanted, lambda s: NOT list_contains(held, s)) AS missing FROM a),
s AS (
  SELECT *, CAST(round(CAST(len(matching) AS DOUBLE) / nullif(len(wanted), 0) * 100) AS INTEGER) AS percentage
  FROM m)"""
add("skill_match", f"""WITH {APPLICATIONS}
SELECT application_id, percentage AS match_percentage,
  CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS job_description_preview,
  array_to_string(matching, ',') AS matching_skills, array_to_string(missing, ',') AS missing_skills
FROM s""")
JSON_ANSWER = """'{' || CASE WHEN percentage IS NULL THEN '' ELSE '"match_percentage":' || percentage || ',' END
  || '"matching_skills":[' || array_to_string(list_transform(matching, lambda x: '"' || x || '"'), ',') || ']}'"""
add("parse_analyses", f"""WITH {APPLICATIONS}
SELECT application_id, CASE WHEN application_id % 4 <> 0 THEN percentage END AS match_percentage,
  CASE WHEN application_id % 4 <> 0 THEN array_to_string(matching, ',') END AS matching_skills,
  CASE WHEN application_id % 4 = 0 THEN 'Sure: ' || {JSON_ANSWER} END AS raw_response
FROM s""")

# -- profiles and actions ------------------------------------------------------

COMPANY = arr(d.PROFILE_COMPANIES)
DATES = arr(d.PROFILE_DATES)
add("experience_search", f"""
SELECT * FROM (
  SELECT c_custkey AS profile_id, CAST(s AS INTEGER) AS position,
    ({COMPANY})[(c_custkey + s) % 4 + 1] AS company, ({DATES})[(c_custkey + s) % 4 + 1] AS dates
  FROM customer, (SELECT unnest([0, 1]) AS s))
WHERE contains(lower(company), 'big four')
  AND TRY_CAST(regexp_extract(trim(string_split(dates, '–')[1]), '(\\S+)$', 1) AS INTEGER) >= 2016""")
add("skills_search", f"""
WITH s AS (
  SELECT c_custkey AS profile_id,
    list_filter([{_title(0)}, {_title(3)}, 'Git'], lambda x: contains(lower(x), 'sql')) AS t,
    list_filter([{_title(5)}], lambda x: contains(lower(x), 'sql')) AS c
  FROM customer)
SELECT profile_id, concat_ws(',', CASE WHEN len(t) > 0 THEN 'technical_development' END,
    CASE WHEN len(c) > 0 THEN 'cloud_infrastructure' END) AS categories,
  array_to_string(list_concat(t, c), ',') AS skills
FROM s WHERE len(t) + len(c) > 0""")
add("skills_search_by_category", f"""
SELECT c_custkey AS profile_id, 'cloud_infrastructure' AS category, {_title(5)} AS skills FROM customer""")
add("profile_sections", """
SELECT c_custkey AS profile_id, 0 AS position, 'State College' AS school, 'BSc' AS degree,
  'Major ' || (c_custkey % 4) AS major FROM customer
UNION ALL
SELECT c_custkey, 1, 'Night School', 'MSc', 'Statistics' FROM customer""")
add("profile_certifications", """
SELECT c_custkey AS profile_id, 0 AS position, 'Cert ' || (c_custkey % 6) AS name FROM customer
UNION ALL SELECT c_custkey, 1, 'Cert X' FROM customer""")
add("profile_document", """
SELECT c_custkey AS profile_id, 'Cert ' || (c_custkey % 6) || '|Cert X' AS certifications,
  'State College|Night School' AS schools, false AS has_projects FROM customer""")
add("action_validation", f"""
WITH a AS (
  SELECT o_orderkey AS i, o_orderkey % 2 = 0 AS c,
    CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 6 = 0 THEN 'recruiter_email'
        WHEN o_orderkey % 10 = 0 THEN 'message' END
      ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'priority' END END AS missing_field
  FROM orders)
SELECT i AS action_id, CASE WHEN c THEN 'contact' ELSE 'shortlist' END AS action, missing_field,
  CASE WHEN missing_field IS NULL THEN CASE WHEN c THEN 'received' ELSE 'shortlisted' END END AS status,
  CASE WHEN missing_field IS NULL THEN CASE WHEN c THEN {lit(fv.CONTACT_MESSAGE)}
    ELSE {lit(fv.SHORTLIST_MESSAGE)} END END AS message,
  CASE WHEN missing_field IS NULL AND c THEN 'conf_' || substr(md5(CAST(i AS VARCHAR)), 1, 8) END
    AS confirmation_id
FROM a""")

# -- screening -----------------------------------------------------------------

add("validate_questions", f"""WITH {TURNS}
SELECT *, CASE WHEN clean = '' THEN 'Question cannot be empty'
  WHEN length(clean) > 500 THEN 'Question cannot exceed 500 characters' END AS reason
FROM (SELECT *, {strip('question')} AS clean FROM questions)""")
add("validate_conversations", f"""WITH {TURNS},
f AS (
  SELECT conv_id, count(*) AS n_messages, bool_and(role IN ('user', 'assistant')) AS roles_ok,
    bool_or({strip('text')} = '') AS any_empty, bool_or(length({strip('text')}) > 500) AS any_long,
    arg_max(role, turn) AS last_role
  FROM turns GROUP BY 1),
r AS (
  SELECT conv_id, n_messages, last_role, CASE
    WHEN NOT roles_ok THEN 'Role must be user or assistant'
    WHEN any_empty THEN 'Message content cannot be empty'
    WHEN any_long THEN 'Message content cannot exceed 500 characters'
    WHEN n_messages > 10 THEN 'Conversation history cannot exceed 10 messages'
    WHEN last_role <> 'user' THEN 'Last message must be from the user' END AS reason
  FROM f)
SELECT *, reason IS NULL AS is_valid FROM r""")
FIRST_MATCH = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(text, {lit('(?i)' + p)}, 0), '')" for p in fv.INJECTION_PATTERNS) + ")"
add("detect_injection", f"""WITH {TURNS}
SELECT conv_id, turn, {FIRST_MATCH} AS injection, {FIRST_MATCH} IS NOT NULL AS is_injection FROM turns""")
add("suspicious_phrases", f"""WITH {TURNS}
SELECT conv_id, turn, {contains_any('text', fv.SUSPICIOUS_PHRASES)} AS is_suspicious FROM turns""")
FLAGGED = f"""{LOG},
marked AS (
  SELECT query_id, client_ip, request_timestamp AS ts, k % 5 = 0 AS is_injection,
    max(CASE WHEN k % 5 = 0 THEN request_timestamp END) OVER (
      PARTITION BY client_ip ORDER BY request_timestamp, query_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS armed
  FROM log)
SELECT query_id, client_ip, ts, is_injection,
  is_injection OR coalesce(ts - armed < INTERVAL 21600 SECOND, false) AS deflected
FROM marked"""
add("flagged_requests", f"WITH {FLAGGED}")
add("stream_ip_flags", f"WITH {FLAGGED}")
add("flag_counts", f"""WITH RECURSIVE {LOG},
r AS (
  SELECT client_ip, request_timestamp AS ts, k % 5 = 0 AS inj,
    row_number() OVER (PARTITION BY client_ip ORDER BY request_timestamp, query_id) AS n
  FROM log),
walk AS (
  SELECT client_ip, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS held, CAST(NULL AS TIMESTAMP) AS armed
  FROM r WHERE n = 1
  UNION ALL
  SELECT r.client_ip, r.n,
    CASE WHEN inj THEN held + 1 WHEN held > 0 AND ts - armed >= INTERVAL 21600 SECOND THEN 0 ELSE held END,
    CASE WHEN inj THEN ts ELSE armed END
  FROM walk w JOIN r ON r.client_ip = w.client_ip AND r.n = w.n + 1)
SELECT client_ip, held AS flag_count, armed AS last_flagged_at
FROM walk QUALIFY row_number() OVER (PARTITION BY client_ip ORDER BY n DESC) = 1 AND held > 0""")
add("rate_limit", log_query("""
SELECT query_id, client_ip, request_timestamp AS ts, date_trunc('day', request_timestamp) AS window_start,
  row_number() OVER (PARTITION BY client_ip, date ORDER BY request_timestamp, query_id) <= 2 AS allowed
FROM log"""))
add("stream_rate_limit", log_query("""
SELECT client_ip, CAST(date AS TIMESTAMP) AS window_start, count(*) AS requests,
  greatest(count(*) - 2, 0) AS rejected
FROM log GROUP BY 1, 2"""))
add("recent_history", f"""WITH {TURNS},
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM turns),
h AS (
  SELECT conv_id, count(*) AS n_messages,
    coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (n > 3), '') AS older_text,
    string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text, chr(10)
      ORDER BY turn) FILTER (n <= 3) AS recent_text
  FROM n WHERE n <= 10 GROUP BY 1)
SELECT *, substr(older_text, 1, 300) AS summary FROM h""")
MESSAGES = f"""{TURNS},
messages AS (
  SELECT conv_id * 100 + turn AS id, 'sender' || (conv_id % 40) || '@example.com' AS sender,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 600 + turn * 5) AS timestamp,
    role, text AS content
  FROM turns)"""
add("sender_history", f"""WITH {MESSAGES}
SELECT sender, CAST(n AS INTEGER) AS recency, id, timestamp, role, content FROM (
  SELECT *, row_number() OVER (PARTITION BY sender ORDER BY timestamp DESC, id DESC) AS n FROM messages)
WHERE n <= 6""")
add("sender_rate_limit", f"""WITH {MESSAGES}
SELECT id AS query_id, sender, timestamp AS ts, date_trunc('hour', timestamp) AS window_start,
  row_number() OVER (PARTITION BY sender, date_trunc('hour', timestamp) ORDER BY timestamp, id) <= 10 AS allowed
FROM messages""")
add("first_contact", f"""WITH {MESSAGES}
SELECT id, sender, row_number() OVER (PARTITION BY sender ORDER BY timestamp, id) = 1 AS is_first_contact
FROM messages""")
add("triage_mail", """
SELECT doc_id AS mail_id, 'sender' || (doc_id % 40) || '@example.com' AS "from",
  't' || (doc_id // 2) AS threadId
FROM documents
WHERE doc_id % 10 <> 0
  AND (doc_id % 3 = 0 OR (doc_id % 7 <> 0 AND doc_id % 5 <> 0))
  AND doc_id % 8 <> 0
  AND (doc_id % 12 = 1 OR (doc_id % 6 <> 0 AND doc_id % 9 <> 0))""")
add("mail_to_question", f"""WITH {DOCS},
q AS (
  SELECT doc_id AS mail_id, 'Subject: ' || CASE WHEN doc_id % 4 <> 0 THEN 'About ' || source
      ELSE '(no subject)' END || chr(10) || chr(10)
    || {strip("CASE WHEN doc_id % 8 = 0 OR text = '' THEN substr(text, 1, 80) ELSE text END")} AS t
  FROM docs)
SELECT mail_id, CASE WHEN length(t) > 500 THEN substr(t, 1, 497) || '...' ELSE t END AS question FROM q""")
add("budget_breaches", """
SELECT * FROM (
  SELECT o_orderkey AS notice_id,
    CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_totalprice END AS cost,
    CASE WHEN o_orderkey % 10 < 2 THEN 0 ELSE CAST(o_custkey AS DOUBLE) * 250 END AS budget,
    CASE WHEN o_orderkey % 10 < 2 THEN 'unknown' ELSE 'budget-' || (o_custkey % 10) END AS budget_name
  FROM orders)
WHERE cost >= budget""")

# -- streams: each equals its batch twin over the whole input ------------------

add("stream_hourly_traffic", hourly(""))
add("stream_session_depth", depth("funnel_stage IS NOT NULL"))

# Searches by way of an index find what the plain ones find.
for name, twin in (
    ("indexed_top_k", "cosine_top_k"), ("probed_top_k_recall", "ann_top_k_recall"), ("retrieve_tiers_indexed", "retrieve_tiers"),
):
    add(name, ORACLES[twin])
