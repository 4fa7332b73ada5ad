"""Registered queries: request telemetry and quotas."""

from pyspark.sql import functions as F

from tidemark.config import LATENCY_BUCKETS
from tidemark.operators import dedup, quota, reliability, telemetry
from tidemark.plans.catalog import micros, query
from tidemark.plans.catalog_ingest import _DUCK_OUTCOME, scratch, stats
from tidemark.plans.testdata import DUCK_NORMAL_PATH, Tables
from tidemark.sources.events import read_load_stats


def rounded(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# -- request log -------------------------------------------------------------------------------

@query("request_counts", f"""
SELECT method, {DUCK_NORMAL_PATH} AS path, CAST(status AS VARCHAR) AS status,
       count(*) AS requests FROM access_log GROUP BY 1, 2, 3""", ("access_log",))
def request_counts(t: Tables):
    return telemetry.request_counts(t.access_log)


_BOUNDS = ", ".join(
    [f"({i}, '{float(b)}', {float(b)}::DOUBLE)" for i, b in enumerate(LATENCY_BUCKETS)]
    + [f"({len(LATENCY_BUCKETS)}, '+Inf', 'inf'::DOUBLE)"])


@query("latency_histogram", f"""
, b(bucket, le, bound) AS (VALUES {_BOUNDS}),
l AS (SELECT method, {DUCK_NORMAL_PATH} AS path, duration_s FROM access_log)
SELECT method, path, bucket, le, count(*) FILTER (WHERE duration_s <= bound) AS le_count,
       count(*) AS count, CAST(sum(CAST(duration_s AS DECIMAL(18,6))) AS DOUBLE) AS sum_s
FROM l, b GROUP BY 1, 2, 3, 4""", ("access_log",))
def latency_histogram(t: Tables):
    return telemetry.latency_histogram(t.access_log)


@query("latency_p95", f"""
, b(bucket, le, bound) AS (VALUES {_BOUNDS}),
h AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, bucket, bound,
             count(*) FILTER (WHERE duration_s <= bound) AS c, count(*) AS n
      FROM access_log, b GROUP BY 1, 2, 3),
e AS (SELECT *, coalesce(lag(c) OVER p, 0) AS pc,
             coalesce(lag(bound) OVER p, 0::DOUBLE) AS lo, 0.95::DOUBLE * n AS r
      FROM h WINDOW p AS (PARTITION BY w ORDER BY bucket)),
f AS (SELECT w, min(bucket) AS bucket FROM e WHERE c >= r GROUP BY 1)
SELECT epoch_us(w) AS window_us, round(CASE WHEN bound = 'inf'::DOUBLE THEN lo
       ELSE lo + (bound - lo) * (r - pc) / (c - pc) END, 9) AS quantile
FROM e JOIN f USING (w, bucket)""", ("access_log",))
def latency_p95(t: Tables):
    return telemetry.latency_p95(t.access_log).select(
        micros("window_start", "window_us"), rounded("quantile", 9))


@query("request_rate", """
SELECT epoch_us(date_trunc('minute', ts)) AS window_us, count(*) AS n,
       count(*) / 60.0::DOUBLE AS per_second FROM access_log GROUP BY 1""", ("access_log",))
def request_rate(t: Tables):
    return telemetry.request_rate(t.access_log).select(
        micros("window_start", "window_us"), "n", "per_second")


@query("endpoint_report", f"""
, l AS (SELECT method || ' ' || {DUCK_NORMAL_PATH} AS name, status, duration_s * 1000.0::DOUBLE AS ms
        FROM access_log),
s AS (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS span FROM access_log)
SELECT name, count(*) AS requests, count(*) FILTER (WHERE status >= 500) AS failures,
       round(quantile_cont(ms, 0.5), 6) AS median_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms,
       round(count(*) / (SELECT span FROM s), 9) AS rps
FROM l GROUP BY 1""", ("access_log",))
def endpoint_report(t: Tables):
    return telemetry.endpoint_report(t.access_log).select(
        "name", "requests", "failures", rounded("median_ms"), rounded("p95_ms"),
        rounded("rps", 9))


_DUCK_TOTAL = """
, l AS (SELECT status, duration_s * 1000.0::DOUBLE AS ms FROM access_log),
s AS (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS span FROM access_log)
SELECT count(*) AS requests, count(*) FILTER (WHERE status >= 500) AS failures,
       printf('%.3f%%', count(*) FILTER (WHERE status >= 500) / count(*) * 100.0::DOUBLE)
           AS error_rate,
       round(quantile_cont(ms, 0.5), 6) AS median_ms, round(avg(ms), 6) AS mean_ms,
       round(quantile_cont(ms, 0.95), 6) AS p95_ms, round(quantile_cont(ms, 0.99), 6) AS p99_ms,
       round(count(*) / (SELECT span FROM s), 9) AS rps
FROM l"""


def _total(df):
    return df.select("requests", "failures", "error_rate", rounded("median_ms"),
                     rounded("mean_ms"), rounded("p95_ms"), rounded("p99_ms"),
                     rounded("rps", 9))


@query("aggregate_report", _DUCK_TOTAL, ("access_log",))
def aggregate_report(t: Tables):
    return _total(telemetry.aggregate_report(t.access_log))


def stats_file(t: Tables) -> str:
    """The endpoint report and its total, written as a load-run statistics file."""
    path = scratch(t)
    log = t.access_log
    total = telemetry.aggregate_report(log).select(
        F.lit("Aggregated").alias("Name"), "requests", "failures", "median_ms", "mean_ms",
        "p95_ms", "p99_ms", "rps")
    each = telemetry.endpoint_report(log).select(
        F.col("name").alias("Name"), "requests", "failures", "median_ms",
        F.lit(None).cast("double").alias("mean_ms"), "p95_ms",
        F.lit(None).cast("double").alias("p99_ms"), "rps")
    none = F.lit(None).cast("double")
    rows = each.unionByName(total).select(
        F.lit("").alias("Type"), "Name", F.col("requests").alias("Request Count"),
        F.col("failures").alias("Failure Count"),
        F.col("median_ms").alias("Median Response Time"),
        F.col("mean_ms").alias("Average Response Time"),
        *[none.alias(c) for c in ("Min Response Time", "Max Response Time",
                                  "Average Content Size")],
        F.col("rps").alias("Requests/s"), none.alias("Failures/s"),
        *[none.alias(c) for c in ("50%", "66%", "75%", "80%", "90%")],
        F.col("p95_ms").alias("95%"), none.alias("98%"), F.col("p99_ms").alias("99%"),
        *[none.alias(c) for c in ("99.9%", "99.99%", "100%")],
    )
    rows.write.csv(path, header=True)
    return path


@query("load_stats_csv", _DUCK_TOTAL, ("access_log",))
def load_stats_csv(t: Tables):
    """The total row of a statistics file that was written and read back."""
    rows = read_load_stats(t.spark, stats_file(t))
    return _total(telemetry.aggregate_row(rows, "row_no"))


_DUCK_STATEMENTS = """
, q AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'SELECT count(*) FROM events WHERE user_id = '
               || user_id ELSE 'SELECT ' || repeat('x', 150) || user_id END AS query,
               value AS duration_ms, event_id % 10 AS rows FROM events)
SELECT substring(query, 1, 120) AS query_preview, count(*) AS calls,
       CAST(round(sum(CAST(duration_ms AS DECIMAL(24,6))), 2) AS DOUBLE) AS total_ms,
       CAST(round(avg(duration_ms), 2) AS DOUBLE) AS mean_ms, CAST(sum(rows) AS BIGINT) AS rows
FROM q GROUP BY query ORDER BY sum(CAST(duration_ms AS DECIMAL(24,6))) DESC, query LIMIT 20"""


def statement_log(t: Tables):
    return t.events.selectExpr(
        "CASE WHEN event_id % 2 = 0 THEN concat('SELECT count(*) FROM events WHERE user_id = ',"
        " user_id) ELSE concat('SELECT ', repeat('x', 150), user_id) END AS query",
        "value AS duration_ms", "event_id % 10 AS rows")


@query("top_statements", _DUCK_STATEMENTS)
def top_statements(t: Tables):
    return telemetry.top_statements(statement_log(t))


@query("top_statements_bounded", _DUCK_STATEMENTS)
def top_statements_bounded(t: Tables):
    """The same without a total per statement: most texts are never compared."""
    return telemetry.top_statements_bounded(statement_log(t))


# -- ingest telemetry --------------------------------------------------------------------------

@query("ingest_rate_by_result", _DUCK_OUTCOME + """
SELECT 'async' AS mode, CASE WHEN deduplicated THEN 'deduplicated' ELSE 'accepted' END AS result,
       count(*) AS n FROM ranked GROUP BY 2""", ("arrivals", "stored"))
def ingest_rate_by_result(t: Tables):
    return telemetry.ingest_rate_by_result(dedup.ingest_outcome(t.arrivals, t.stored, "async"))


@query("ingest_rate", _DUCK_OUTCOME + """
SELECT epoch_us(date_trunc('minute', arrival_ts)) AS window_us,
       CASE WHEN deduplicated THEN 'deduplicated' ELSE 'accepted' END AS result,
       count(*) AS n, count(*) / 60.0::DOUBLE AS per_second FROM ranked GROUP BY 1, 2""",
       ("arrivals", "stored"))
def ingest_rate(t: Tables):
    outcomes = dedup.ingest_outcome(t.arrivals, t.stored, "async")
    return telemetry.ingest_rate(outcomes, "arrival_ts").select(
        micros("window_start", "window_us"), "result", "n", "per_second")


@query("writes_by_result", _DUCK_OUTCOME + """
SELECT CASE WHEN deduplicated THEN 'conflict' ELSE 'inserted' END AS result, count(*) AS n
FROM ranked GROUP BY 1""", ("arrivals", "stored"))
def writes_by_result(t: Tables):
    return telemetry.writes_by_result(dedup.ingest_outcome(t.arrivals, t.stored, "async"))


@query("dlq_by_reason", """
SELECT split_part(verdict, ':', 1) AS reason, count(*) AS n FROM routed
WHERE route = 'dlq' GROUP BY 1""", ("routed",))
def dlq_by_reason(t: Tables):
    return telemetry.dlq_by_reason(
        reliability.to_dead_letter(reliability.route_messages(t.classified)))


@query("queue_gauges", """
SELECT 'event_stream_lag' AS gauge, count(*) FILTER (WHERE route = 'pending') AS value
FROM routed
UNION ALL SELECT 'event_stream_dlq_size', count(*) FILTER (WHERE route = 'dlq') FROM routed""",
       ("routed",))
def queue_gauges(t: Tables):
    return telemetry.queue_gauges(stats(t))


# -- quotas ------------------------------------------------------------------------------------
# The given events are too sparse for a quota, so they are replayed two per second.

def burst(t: Tables):
    return t.events.select(
        (F.col("user_id") % 3).alias("k"), (F.col("event_id") * 500).alias("t"), "event_id")


DUCK_QUOTA = """
, r AS (SELECT user_id % 3 AS k, event_id * 500 AS t,
               row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS n FROM events),
q AS (SELECT k, n, t, [t] AS st, true AS allowed, CAST(1 AS BIGINT) AS cnt,
             CAST(60 AS BIGINT) AS reset_s FROM r WHERE n = 1
      UNION ALL
      SELECT x.k, x.n, x.t,
             CASE WHEN len(x.f) < 30 THEN list_append(x.f, x.t) ELSE x.f END,
             len(x.f) < 30,
             CASE WHEN len(x.f) < 30 THEN len(x.f) + 1 ELSE len(x.f) END,
             CASE WHEN len(x.f) < 30 THEN 60
                  ELSE CAST(ceil((x.f[1] + 60000 - x.t) / 1000) AS BIGINT) END
      FROM (SELECT r.k, r.n, r.t, list_filter(q.st, lambda v: v > r.t - 60000) AS f
            FROM q JOIN r ON r.k = q.k AND r.n = q.n + 1) x)
SELECT k, t, allowed, cnt AS "count", reset_s FROM q"""


@query("sliding_quota", DUCK_QUOTA, recursive=True)
def sliding_quota(t: Tables):
    return quota.sliding_quota(burst(t), "k", "t", 30, order=["event_id"]).select(
        "k", "t", "allowed", "count", "reset_s")


@query("rolling_count", """
SELECT user_id % 3 AS k, event_id * 500 AS t,
       count(*) OVER (PARTITION BY user_id % 3 ORDER BY event_id * 500
                      RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS rolling FROM events""")
def rolling_count(t: Tables):
    return quota.rolling_count(burst(t), "k", "t").select("k", "t", "rolling")


def ruled(t: Tables):
    """Twenty requests per second from a few addresses, with smaller limits than usual."""
    log = t.access_log.select(
        "n", (F.col("n") * 50).alias("t"), F.concat("ip", F.lit("")).alias("ip"), "user_id",
        "event_write")
    return quota.quota_scopes(log, "t", ["n"], {"ip": 30, "user": 12, "events": 5})


def _scope(name: str, rows: str, owner: str, limit: int) -> str:
    """One scope in SQL: its requests in order per owner, then one request per step."""
    return f"""
r_{name} AS (SELECT n, t, {owner} AS k,
                    row_number() OVER (PARTITION BY {owner} ORDER BY n) AS i FROM {rows}),
q_{name} AS (SELECT k, i, n, t, [t] AS st, true AS allowed, CAST(1 AS BIGINT) AS cnt
             FROM r_{name} WHERE i = 1
             UNION ALL
             SELECT x.k, x.i, x.n, x.t,
                    CASE WHEN len(x.f) < {limit} THEN list_append(x.f, x.t) ELSE x.f END,
                    len(x.f) < {limit},
                    CAST(least(len(x.f) + 1, {limit}) AS BIGINT)
             FROM (SELECT r.k, r.i, r.n, r.t, list_filter(q.st, lambda v: v > r.t - 60000) AS f
                   FROM q_{name} q JOIN r_{name} r ON r.k = q.k AND r.i = q.i + 1) x)"""


DUCK_SCOPES = f"""
, log AS (SELECT n, n * 50 AS t, ip, user_id, event_write FROM access_log),
{_scope("ip", "log", "ip", 30)},
l_user AS (SELECT log.* FROM log JOIN q_ip q ON q.n = log.n WHERE q.allowed),
{_scope("user", "(SELECT * FROM l_user WHERE user_id IS NOT NULL)", "user_id", 12)},
l_events AS (SELECT l.* FROM l_user l LEFT JOIN q_user q ON q.n = l.n
             WHERE coalesce(q.allowed, true)),
{_scope("events", "(SELECT * FROM l_events WHERE event_write)",
        "coalesce(CAST(user_id AS VARCHAR), ip)", 5)},
ruled AS (
  SELECT log.n, CASE WHEN NOT i.allowed THEN 'ip' WHEN NOT u.allowed THEN 'user'
                     WHEN NOT e.allowed THEN 'events' END AS denied_scope,
         30 - i.cnt AS ip_remaining, 12 - u.cnt AS user_remaining, 5 - e.cnt AS events_remaining
  FROM log LEFT JOIN q_ip i ON i.n = log.n LEFT JOIN q_user u ON u.n = log.n
       LEFT JOIN q_events e ON e.n = log.n)
"""


@query("quota_scopes", DUCK_SCOPES + "SELECT * FROM ruled", ("access_log",), recursive=True)
def quota_scopes(t: Tables):
    return ruled(t).select("n", "denied_scope", "ip_remaining", "user_remaining",
                           "events_remaining")


@query("quota_hits_by_scope", DUCK_SCOPES + """
SELECT denied_scope AS scope, count(*) AS n FROM ruled WHERE denied_scope IS NOT NULL GROUP BY 1""",
       ("access_log",), recursive=True)
def quota_hits_by_scope(t: Tables):
    return telemetry.quota_hits_by_scope(ruled(t))
