"""Fixed schemas; nothing but the CSV reader infers types."""

from pyspark.sql import types as T

FUNNEL_FIELDS = [
    T.StructField(name, T.StringType())
    for name in (
        "session_id", "search_campaign", "traffic_source",
        "funnel_stage", "device_type", "geo_region",
    )
]

# One row per served request, as the service logs it.
LIVE_LOG = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("query_params", T.StringType()),
        T.StructField("recruiter_domain", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("response_time_ms", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
        *FUNNEL_FIELDS,
    ]
)

# The historic log; also the layout of its CSV form.
HISTORIC_LOG = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("recruiter_domain", T.StringType()),
        T.StructField("endpoint_hit", T.StringType()),
        T.StructField("skill_searched", T.StringType()),
        T.StructField("response_time_ms", T.IntegerType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("referer_url", T.StringType()),
    ]
)

# The warehouse table the reports read, partitioned by `date`.
WAREHOUSE = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("request_timestamp", T.TimestampType()),
        T.StructField("http_method", T.StringType()),
        T.StructField("endpoint_path", T.StringType()),
        T.StructField("query_params", T.StringType()),
        T.StructField("recruiter_domain", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("http_status_code", T.IntegerType()),
        T.StructField("response_time_ms", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("hour_of_day", T.IntegerType()),
        T.StructField("day_of_week", T.StringType()),
        *FUNNEL_FIELDS,
        T.StructField("date", T.DateType()),
    ]
)

# A served request before enrichment.
RAW_REQUEST = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("started_at", T.DoubleType()),
        T.StructField("finished_at", T.DoubleType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("query_params", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("client_ip", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
    ]
)

WEAK_MATCH = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("top_distance", T.DoubleType()),
        T.StructField("low_confidence", T.BooleanType()),
    ]
)

PROFILE = T.StructType(
    [
        T.StructField("profile_id", T.LongType()),
        T.StructField(
            "contact",
            T.StructType(
                [T.StructField(n, T.StringType()) for n in ("name", "email", "linkedin", "location")]
            ),
        ),
        T.StructField("summary", T.StringType()),
        T.StructField("skills", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField(
            "experience",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("company", T.StringType()),
                        T.StructField("title", T.StringType()),
                        T.StructField("dates", T.StringType()),
                        T.StructField(
                            "projects",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("name", T.StringType()),
                                        T.StructField("subtitle", T.StringType()),
                                        T.StructField("bullets", T.ArrayType(T.StringType())),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
        T.StructField(
            "education",
            T.ArrayType(
                T.StructType(
                    [T.StructField(n, T.StringType()) for n in ("school", "degree", "major")]
                )
            ),
        ),
        T.StructField("certifications", T.ArrayType(T.StringType())),
        T.StructField(
            "portfolio_projects",
            T.ArrayType(
                T.StructType([T.StructField(n, T.StringType()) for n in ("name", "description")])
            ),
        ),
    ]
)

SKILL_ANALYSIS = T.StructType(
    [
        T.StructField("match_percentage", T.IntegerType()),
        T.StructField("matching_skills", T.ArrayType(T.StringType())),
        T.StructField("missing_skills", T.ArrayType(T.StringType())),
        T.StructField("recommendations", T.ArrayType(T.StringType())),
    ]
)
