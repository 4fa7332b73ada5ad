"""Explicit schemas. Nothing in the package infers a schema from data."""

from pyspark.sql import types as T

# The event table.
EVENTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("properties", T.StringType()),
    T.StructField("client_ts", T.TimestampType()),
    T.StructField("server_ts", T.TimestampType()),
    T.StructField("ip_hash", T.StringType()),
    T.StructField("user_agent", T.StringType()),
])

# Columns a reader of one event may see (no ip hash, no user agent).
PUBLIC_EVENT_COLUMNS = [
    "event_id", "user_id", "session_id", "event_type", "properties", "client_ts", "server_ts",
]

# The fields inside a message, in wire order.
PAYLOAD_FIELDS = [
    "event_id", "user_id", "session_id", "event_type", "properties", "client_ts", "ip_hash",
    "user_agent",
]

# The stored metrics: a row per day, metric and set of dimensions; per window; per cohort.
DAILY_METRICS = T.StructType([
    T.StructField("metric_date", T.DateType()),
    T.StructField("name", T.StringType()),
    T.StructField("dimensions", T.StringType()),
    T.StructField("dim_hash", T.StringType()),
    T.StructField("value", T.DecimalType(20, 4)),
    T.StructField("computed_at", T.TimestampType()),
])
RETENTION_SNAPSHOTS = T.StructType([
    T.StructField("cohort_date", T.DateType()),
    *[T.StructField(n, T.LongType()) for n in ("cohort_size", "d1_retained", "d7_retained")],
    *[T.StructField(n, T.DecimalType(8, 4)) for n in ("d1_rate", "d7_rate")],
    T.StructField("computed_at", T.TimestampType()),
])


def funnel_snapshots(steps) -> T.StructType:
    return T.StructType([
        T.StructField("window_start", T.DateType()),
        T.StructField("window_end", T.DateType()),
        *[T.StructField(s, T.LongType()) for s in steps],
        T.StructField("computed_at", T.TimestampType()),
    ])


MESSAGES = T.StructType([
    T.StructField("message_id", T.StringType()),
    T.StructField("data", T.StringType()),
])

# The raw synthetic event table that ships with the test data.
RAW_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

# Statistics file of a load run. The header names of that file.
LOAD_STATS = T.StructType([
    T.StructField("Type", T.StringType()),
    T.StructField("Name", T.StringType()),
    T.StructField("Request Count", T.LongType()),
    T.StructField("Failure Count", T.LongType()),
    T.StructField("Median Response Time", T.DoubleType()),
    T.StructField("Average Response Time", T.DoubleType()),
    T.StructField("Min Response Time", T.DoubleType()),
    T.StructField("Max Response Time", T.DoubleType()),
    T.StructField("Average Content Size", T.DoubleType()),
    T.StructField("Requests/s", T.DoubleType()),
    T.StructField("Failures/s", T.DoubleType()),
    *[
        T.StructField(p, T.DoubleType())
        for p in ("50%", "66%", "75%", "80%", "90%", "95%", "98%", "99%", "99.9%", "99.99%",
                  "100%")
    ],
])
