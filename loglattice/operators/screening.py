"""Validation, injection screening, timed flags, rate limits and history windows.

Requests of one address or sender are never gathered into one group: flags are
worked out per (address, slice of time), and limits and histories keep only the
few rows they need of a key before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import ANY_CASE, any_of, contains_any, strip, truncated

MAX_CHARS = 500
MAX_MESSAGES = 10
FLAG_SECONDS = 300
SLICES = 16


def _length_reason(clean: Column, subject: str) -> Column:
    return F.when(clean == "", f"{subject} cannot be empty").when(
        F.length(clean) > MAX_CHARS, f"{subject} cannot exceed {MAX_CHARS} characters"
    )


def validate_questions(questions: DataFrame, column: str = "question") -> DataFrame:
    """The trimmed text and why it is rejected, NULL if it is not."""
    return questions.withColumn("clean", strip(F.col(column))).withColumn(
        "reason", _length_reason(F.col("clean"), "Question")
    )


def validate_conversations(turns: DataFrame) -> DataFrame:
    """One verdict per conversation; message faults come before list faults."""
    clean = strip(F.col("text"))
    facts = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.bool_and(F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)))
        .alias("roles_ok"),
        F.bool_or(F.coalesce(clean, F.lit("")) == "").alias("any_empty"),
        F.bool_or(F.length(clean) > MAX_CHARS).alias("any_long"),
        F.max_by("role", "turn").alias("last_role"),
    )
    reason = (
        F.when(~F.col("roles_ok"), "Role must be user or assistant")
        .when(F.col("any_empty"), "Message content cannot be empty")
        .when(F.col("any_long"), f"Message content cannot exceed {MAX_CHARS} characters")
        .when(
            F.col("n_messages") > MAX_MESSAGES,
            f"Conversation history cannot exceed {MAX_MESSAGES} messages",
        )
        .when(F.col("last_role") != "user", "Last message must be from the user")
    )
    return facts.select("conv_id", "n_messages", "last_role", reason.alias("reason")).withColumn(
        "is_valid", F.col("reason").isNull()
    )


def injection_match(text: Column) -> Column:
    """What the first injection pattern that matches anywhere matched.

    Nearly all texts match none, so one combined pattern is tried first and
    the ordered ones only where it hits.
    """
    hits = [
        F.nullif(F.regexp_extract(text, ANY_CASE + p, 0), F.lit(""))
        for p in fv.INJECTION_PATTERNS
    ]
    return F.when(text.rlike(any_of(fv.INJECTION_PATTERNS)), F.coalesce(*hits))


def detect_injection(texts: DataFrame, column: str = "text") -> DataFrame:
    return texts.withColumn("injection", injection_match(F.col(column))).withColumn(
        "is_injection", F.col("injection").isNotNull()
    )


def suspicious_phrases(texts: DataFrame, column: str = "text") -> DataFrame:
    return texts.withColumn(
        "is_suspicious", contains_any(F.col(column), fv.SUSPICIOUS_PHRASES)
    )


def _slice(ttl: int) -> Column:
    """Time in steps of a sixteenth of the flag's lifetime."""
    return F.floor(F.unix_micros("ts") * SLICES / F.lit(ttl * 1_000_000)).cast("bigint")


def _with_last_injection(
    requests: DataFrame, ttl: int, earlier: DataFrame | None = None
) -> DataFrame:
    """Adds `_slice` and `_last`, the newest injection before each request.

    Time is cut into slices. Each slice gets one carried row per address, the
    last injection of the slices before it that its flag can reach, which are
    maxima combined before they are shuffled; so only the requests of one address
    in one slice are ordered together. `earlier` holds injections (client_ip,
    ts) known from before; they only arm flags.
    """

    def armed(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.lit(None).cast("bigint").alias("query_id"), "client_ip", "ts",
            F.lit(True).alias("is_injection"), F.lit(True).alias("_carried"), "_slice",
        )

    rows = requests.select(
        "query_id", "client_ip", "ts", "is_injection",
        F.lit(False).alias("_carried"), _slice(ttl).alias("_slice"),
    )
    if earlier is not None:
        rows = rows.unionByName(armed(earlier.withColumn("_slice", _slice(ttl))))
    newest = rows.where("is_injection").groupBy("client_ip", "_slice").agg(F.max("ts").alias("ts"))
    reached = newest.withColumn("_ahead", F.explode(F.sequence(F.lit(1), F.lit(SLICES + 1))))
    carried = armed(
        reached.groupBy("client_ip", (F.col("_slice") + F.col("_ahead")).alias("_slice"))
        .agg(F.max("ts").alias("ts"))
    )
    before = (
        Window.partitionBy("client_ip", "_slice")
        .orderBy("ts", F.desc("_carried"), "query_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.unionByName(carried)
        .withColumn("_last", F.max(F.when(F.col("is_injection"), F.col("ts"))).over(before))
        .where(~F.col("_carried"))
        .drop("_carried")
    )


def _flagged(ttl: int) -> Column:
    age = F.unix_micros("ts") - F.unix_micros("_last")
    return F.coalesce(age < ttl * 1_000_000, F.lit(False))


def flagged_requests(
    requests: DataFrame, ttl: int = FLAG_SECONDS, earlier: DataFrame | None = None
) -> DataFrame:
    """Which requests are deflected: injections, and any request whose address
    injected less than `ttl` seconds before it."""
    return _with_last_injection(requests, ttl, earlier).select(
        "query_id",
        "client_ip",
        "ts",
        "is_injection",
        (F.col("is_injection") | _flagged(ttl)).alias("deflected"),
    )


def flag_counts(requests: DataFrame, ttl: int = FLAG_SECONDS) -> DataFrame:
    """Injections an address has on its flag, and when it was last armed.

    The count only falls back to nothing when a benign request finds the flag
    expired, and that is exactly a benign request that is not deflected. So the
    count is the number of injections after the last such request: taken per
    slice first, then over the slices of an address.
    """
    spot = F.struct("ts", "query_id")
    whole_slice = Window.partitionBy("client_ip", "_slice")
    clears = ~F.col("is_injection") & ~_flagged(ttl)
    slices = (
        _with_last_injection(requests, ttl)
        .withColumn("_clear", F.max(F.when(clears, spot)).over(whole_slice))
        .groupBy("client_ip", "_slice")
        .agg(
            F.count_if(
                F.col("is_injection") & (F.col("_clear").isNull() | (spot > F.col("_clear")))
            ).alias("n"),
            F.bool_or(F.col("_clear").isNotNull()).alias("cleared"),
            F.max(F.when(F.col("is_injection"), F.col("ts"))).alias("last"),
        )
    )
    last_cleared = F.max(F.when(F.col("cleared"), F.col("_slice"))).over(
        Window.partitionBy("client_ip")
    )
    return (
        slices.withColumn("_from", last_cleared)
        .where(F.col("_from").isNull() | (F.col("_slice") >= F.col("_from")))
        .groupBy("client_ip")
        .agg(F.sum("n").alias("flag_count"), F.max(F.when(F.col("n") > 0, F.col("last"))).alias("last_flagged_at"))
        .where(F.col("flag_count") > 0)
    )


def rate_limit(
    requests: DataFrame, limit: int = 10, window: str = "1 minute", key: str = "client_ip"
) -> DataFrame:
    """Which requests stay within `limit` per key and clock-aligned window.

    A window is told by its `limit`-th request: all up to that one are allowed.
    Each task cuts its share of a window down to `limit` rows before the
    shuffle that finds it. Only windows that reach the limit have such a
    request, so what is joined back is small and a hot key stays spread out.
    A limit of zero allows nothing; a negative one is an error.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    spot = F.struct("ts", "query_id")
    rows = requests.select(
        "query_id", key, "ts", F.window("ts", window)["start"].alias("window_start")
    )
    order = Window.partitionBy(key, "window_start").orderBy("ts", "query_id")
    last_allowed = (
        rows.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") == limit)
        .select(F.col(key).alias("_key"), F.col("window_start").alias("_start"),
                spot.alias("_last"))
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("window_start") == F.col("_start"))
    within = F.lit(limit > 0) & (F.col("_last").isNull() | (spot <= F.col("_last")))
    return rows.join(last_allowed, same, "left").select(
        "query_id", key, "ts", "window_start", within.alias("allowed")
    )


def recent_history(turns: DataFrame, keep: int = 3, cap: int = 10) -> DataFrame:
    """Per conversation: the last `keep` turns as lines, what came before them
    (within `cap`) as lines, and the summary used when no model writes one."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = (
        turns.select("conv_id", "turn", "role", "text")
        .withColumn("_n", F.row_number().over(newest))
        .where(F.col("_n") <= cap)
    )
    speaker = F.when(F.col("role") == "user", "User").otherwise("Assistant")

    def joined(condition: Column, line: Column) -> Column:
        lines = F.sort_array(F.collect_list(F.when(condition, F.struct("turn", line.alias("line")))))
        return F.array_join(F.transform(lines, lambda x: x["line"]), "\n")

    is_recent = F.col("_n") <= keep
    older = joined(~is_recent, F.concat_ws(": ", "role", "text"))
    recent = joined(is_recent, F.concat(speaker, F.lit(": "), F.col("text")))
    return (
        kept.groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("n_messages"),
            older.alias("older_text"),
            recent.alias("recent_text"),
        )
        .withColumn("summary", F.substring("older_text", 1, 300))
    )


def sender_history(messages: DataFrame, n: int = 6) -> DataFrame:
    """The last n messages per sender, numbered from the newest."""
    newest = Window.partitionBy("sender").orderBy(F.desc("timestamp"), F.desc("id"))
    return (
        messages.withColumn("recency", F.row_number().over(newest))
        .where(F.col("recency") <= n)
        .select("sender", "recency", "id", "timestamp", "role", "content")
    )


def first_contact(messages: DataFrame) -> DataFrame:
    """Flags the first message of each sender. The firsts are a map-side
    aggregate; they meet the messages by message id, not by sender."""
    firsts = messages.groupBy("sender").agg(
        F.min(F.struct("timestamp", "id"))["id"].alias("id")
    )
    marks = firsts.select("id", F.lit(True).alias("is_first_contact"))
    return messages.join(marks, "id", "left").withColumn(
        "is_first_contact", F.coalesce("is_first_contact", F.lit(False))
    )


def triage_mail(mail: DataFrame, bot_address: str) -> DataFrame:
    """Mail worth answering. Comparisons ignore case."""

    def header(name: str) -> Column:
        return F.coalesce(F.try_element_at("headers", F.lit(name)), F.lit(""))

    labels = F.coalesce("labelIds", F.array().cast("array<string>"))
    not_from_bot = ~F.contains(
        F.lower(F.coalesce("from", F.lit(""))), F.lit(bot_address.lower())
    )
    submitted = F.lower(header("auto-submitted"))
    joined = F.lower(F.array_join(labels, ","))
    keep = (
        not_from_bot
        & (header("x-auto-reply-type") == "")
        & submitted.isin("", "no")
        & (F.coalesce("text", F.lit("")) != "")
        & ~F.arrays_overlap(labels, F.array(*[F.lit(v) for v in fv.ANSWERED_LABELS]))
    )
    for label in fv.JUNK_LABELS:
        keep = keep & ~F.contains(joined, F.lit(label.lower()))
    return mail.where(keep)


def _or_else(column: str, other: Column) -> Column:
    """The column, or the other value where it is NULL or empty."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), other)


def mail_to_question(mail: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Subject and body as one question of at most `max_chars` characters."""
    body = strip(_or_else("text", F.coalesce("snippet", F.lit(""))))
    subject = strip(_or_else("subject", F.lit(fv.DEFAULT_SUBJECT)))
    whole = F.concat(F.lit("Subject: "), subject, F.lit("\n\n"), body)
    return mail.withColumn("question", truncated(whole, max_chars))


def budget_breaches(notices: DataFrame) -> DataFrame:
    """Decoded notices whose cost has reached the budget. A missing amount is
    zero, so an empty notice is a breach; text that is no JSON is not."""
    text = F.make_valid_utf8(F.try_to_binary("data", F.lit("base64")).cast("string"))
    body = F.try_parse_json(text)

    def amount(name: str) -> Column:
        return F.coalesce(F.try_variant_get("_body", f"$.{name}", "double"), F.lit(0.0))

    name = F.try_variant_get("_body", "$.budgetDisplayName", "string")
    return (
        notices.withColumn("_body", body)
        .where(F.col("_body").isNotNull())
        .withColumn("cost", amount("costAmount"))
        .withColumn("budget", amount("budgetAmount"))
        .withColumn("budget_name", F.coalesce(name, F.lit("unknown")))
        .where(F.col("cost") >= F.col("budget"))
        .drop("_body", "data")
    )
