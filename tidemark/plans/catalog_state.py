"""Registered queries: answers from stored state instead of events. Each builds its state from the whole
table, in batches, and then reads the state alone."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import retention, sketches, user_sets
from tidemark.plans import user_state
from tidemark.plans.catalog import micros, query, text
from tidemark.plans.catalog_ingest import scratch
from tidemark.plans.catalog_streams import board, raw_stream
from tidemark.plans.testdata import ACCESS_COLUMNS, DUCK_NORMAL_PATH, Tables
from tidemark.session import materialize
from tidemark.sources.buckets import KeyTable
from tidemark.streaming import live

STEPS = ["view", "search", "add_to_cart", "order"]

_DUCK_WINDOWS = """
, w AS (SELECT DISTINCT CAST(server_ts AS DATE) AS window_start FROM std),
x AS (SELECT window_start, window_start + 6 AS window_end FROM w)
"""


def windows(t: Tables) -> DataFrame:
    """Seven days from every day of the table."""
    return t.std.select(F.to_date("server_ts").alias("window_start")).distinct().withColumn(
        "window_end", F.date_add("window_start", 6).cast("date"))


def stored_bitmaps(t: Tables) -> DataFrame:
    """The state after two batches, the second of which adds late events to every day."""
    path = f"{scratch(t)}/users"
    late = F.col("n") % 3 == 0
    for i, batch in enumerate((t.std.filter(~late), t.std.filter(late))):
        user_state.add_batch(batch, path, i)
    return user_state.read_bitmaps(t.spark, path)


@query("bitmap_weekly_users", _DUCK_WINDOWS + """
SELECT CAST(window_start AS VARCHAR) AS window_start, CAST(window_end AS VARCHAR) AS window_end,
       count(DISTINCT user_id) AS users
FROM x LEFT JOIN std ON CAST(server_ts AS DATE) BETWEEN window_start AND window_end
GROUP BY 1, 2, x.window_start""", ("std",))
def bitmap_weekly_users(t: Tables):
    return user_sets.users_of_windows(stored_bitmaps(t), windows(t)).select(
        text("window_start"), text("window_end"), "users")


@query("bitmap_daily_users", """
SELECT CAST(CAST(server_ts AS DATE) AS VARCHAR) AS metric_date, count(DISTINCT user_id) AS users
FROM std WHERE user_id IS NOT NULL GROUP BY 1""", ("std",))
def bitmap_daily_users(t: Tables):
    return user_sets.count_users(stored_bitmaps(t), ["metric_date"]).select(
        text("metric_date"), "users")


@query("bitmap_funnel", _DUCK_WINDOWS + """
SELECT CAST(window_start AS VARCHAR) AS window_start, CAST(window_end AS VARCHAR) AS window_end,
       count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS "view",
       count(DISTINCT CASE WHEN event_type = 'search' THEN user_id END) AS search,
       count(DISTINCT CASE WHEN event_type = 'add_to_cart' THEN user_id END) AS add_to_cart,
       count(DISTINCT CASE WHEN event_type = 'order' THEN user_id END) AS "order"
FROM x LEFT JOIN std ON CAST(server_ts AS DATE) BETWEEN window_start AND window_end
GROUP BY 1, 2, x.window_start""", ("std",))
def bitmap_funnel(t: Tables):
    return user_sets.funnel_of_windows(stored_bitmaps(t), windows(t)).select(
        text("window_start"), text("window_end"), *STEPS)


@query("retention_sketch", """
SELECT CAST(CAST(first_ts AS DATE) AS VARCHAR) AS cohort_date, true AS within_5_percent
FROM (SELECT min(server_ts) AS first_ts FROM std WHERE user_id IS NOT NULL GROUP BY user_id)
GROUP BY 1""", ("std",))
def retention_sketch(t: Tables):
    """Cohorts and activity are stored as sketches of two batches each, merged when they are read."""
    half = F.col("n") % 2 == 0
    active = sketches.merge_theta(materialize(
        sketches.activity_sketches(t.std.filter(half)).unionByName(
            sketches.activity_sketches(t.std.filter(~half)))), ["metric_date"])
    cohorts = materialize(sketches.cohort_sketches(retention.first_seen(t.std)))
    exact = retention.retention_series(t.std).select(
        "cohort_date", *[F.col(c).alias(f"_{c}") for c in COUNTS])
    near = F.lit(True)
    for c in COUNTS:
        near = near & (F.abs(F.col(c) - F.col(f"_{c}")) <= 0.05 * F.col(f"_{c}"))
    return sketches.retention_estimate(cohorts, active).join(exact, "cohort_date", "left").select(
        text("cohort_date"), F.coalesce(near, F.lit(False)).alias("within_5_percent"))


COUNTS = ("cohort_size", "d1_retained", "d7_retained")


def near_ranks(report: DataFrame, log: DataFrame, error: float = 0.02) -> DataFrame:
    """Whether the share of requests up to each estimated quantile is the one asked for, up to `error`."""
    ms = F.col("duration_s").cast("double") * 1000
    rows = log.filter(F.col("duration_s").isNotNull()).withColumn(
        "path", S.normalize_path("path")).join(report, ["method", "path"])
    near = F.lit(True)
    for name, q in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)):
        near = near & (F.count_if(ms < F.col(name)) / F.count("*") <= q + error) & (
            F.count_if(ms <= F.col(name)) / F.count("*") >= q - error)
    return rows.groupBy("method", "path", "requests", "failures").agg(near.alias("within_2_percent"))


_DUCK_REPORT = f"""
SELECT method, {DUCK_NORMAL_PATH} AS path, count(*) AS requests,
       count(*) FILTER (WHERE status >= 500) AS failures, true AS within_2_percent
FROM access_log WHERE duration_s IS NOT NULL GROUP BY 1, 2"""


@query("latency_sketch_report", _DUCK_REPORT, ("access_log",))
def latency_sketch_report(t: Tables):
    """Sketches of five minutes each, merged over the whole range."""
    stored = materialize(sketches.latency_sketches(t.access_log))
    return near_ranks(sketches.latency_report(stored), t.access_log)


@query("stream_latency_sketch", _DUCK_REPORT, ("access_log",))
def stream_latency_sketch(t: Tables):
    """The same from a board that a stream keeps up to date."""
    stream = raw_stream(t).selectExpr(*ACCESS_COLUMNS).withColumn("ts", F.col("ts").cast("timestamp"))
    shown = board(t, live.stream_latency(stream), ["at", "method", "path"], "window_date")
    return near_ranks(sketches.latency_report(shown), t.access_log)


@query("first_seen_bucketed", """
SELECT user_id, epoch_us(min(server_ts)) AS first_us FROM std WHERE user_id IS NOT NULL
GROUP BY user_id""", ("std",))
def first_seen_bucketed(t: Tables):
    """Two batches, the later events first, so that the second one moves first times back."""
    name = uuid.uuid4().hex
    table = KeyTable(f"first_seen_{name}", f"{scratch(t)}/first_seen", "user_id", parts=8, buckets=8)
    late = F.to_date("server_ts") <= "2024-01-08"
    for batch in (t.std.filter(~late), t.std.filter(late)):
        user_state.add_first_seen(batch, table)
    return user_state.first_seen_table(t.spark, table, t.std).select(
        "user_id", micros("first_ts", "first_us"))
