"""Registered queries: user, funnel, retention and activity metrics, snapshots, directory."""

from pyspark.sql import functions as F

from tidemark.operators import activity, directory, funnel, retention, users
from tidemark.plans import readthrough, snapshots
from tidemark.plans.catalog import query, text
from tidemark.plans.catalog_ingest import scratch
from tidemark.plans.summary import metrics_summary
from tidemark.plans.testdata import Tables
from tidemark.session import materialize
from tidemark.sources import tables

STEPS = ["view", "search", "add_to_cart", "order"]


def as_double(c: str, alias: str | None = None):
    return F.col(c).cast("double").alias(alias or c)


# -- daily active users ------------------------------------------------------------------------

@query("dau", """
SELECT '2024-01-15' AS metric_date, count(DISTINCT user_id) AS dau FROM std
WHERE CAST(server_ts AS DATE) = DATE '2024-01-15'""", ("std",))
def dau(t: Tables):
    return users.dau(t.std, "2024-01-15").select(text("metric_date"), "dau")


@query("dau_series", """
, days AS (SELECT CAST(unnest(generate_series(DATE '2023-12-31', DATE '2024-01-31',
                                              INTERVAL 1 DAY)) AS DATE) AS d)
SELECT CAST(days.d AS VARCHAR) AS metric_date, 'dau' AS name, '{}' AS dimensions,
       '' AS dim_hash, CAST(count(DISTINCT s.user_id) AS DOUBLE) AS value
FROM days LEFT JOIN std s ON CAST(s.server_ts AS DATE) = days.d GROUP BY 1""", ("std",))
def dau_series(t: Tables):
    return users.dau_series(t.std, "2023-12-31", "2024-01-31").select(
        text("metric_date"), "name", "dimensions", "dim_hash", as_double("value"))


@query("dau_hll", """
SELECT CAST(CAST(server_ts AS DATE) AS VARCHAR) AS metric_date,
       count(DISTINCT user_id) AS dau, true AS within_5_percent
FROM std WHERE user_id IS NOT NULL GROUP BY 1""", ("std",))
def dau_hll(t: Tables):
    """Sketch estimates next to the exact counts; the estimate itself differs per engine, so
    the check is that it is close."""
    estimates = users.dau_estimate(users.dau_sketches(t.std))
    exact = users.users_per_day(t.std)
    near = F.abs(F.col("dau_estimate") / F.col("dau") - 1) < 0.05
    return exact.join(estimates, "metric_date").select(
        text("metric_date"), "dau", near.alias("within_5_percent"))


@query("expire_sketches", """
, s AS (SELECT CAST(server_ts AS DATE) AS d, max(server_ts) AS u FROM std
        WHERE user_id IS NOT NULL GROUP BY 1)
SELECT CAST(d AS VARCHAR) AS metric_date FROM s WHERE u > (SELECT t FROM now) - INTERVAL 3 DAY
""", ("std", "now"))
def expire_sketches(t: Tables):
    return users.expire_sketches(users.dau_sketches(t.std), t.now).select(text("metric_date"))


@query("active_users_24h", """
SELECT count(DISTINCT user_id) AS active_users FROM std
WHERE server_ts >= (SELECT t FROM now) - INTERVAL 24 HOUR""", ("std", "now"))
def active_users_24h(t: Tables):
    return users.active_users(t.std, t.now)


@query("daily_metric_by_dim", """
SELECT CAST(CAST(server_ts AS DATE) AS VARCHAR) AS metric_date, 'dau' AS name,
       '{"event_type":"' || event_type || '"}' AS dimensions,
       sha256('{"event_type":"' || event_type || '"}') AS dim_hash,
       CAST(count(DISTINCT user_id) AS DOUBLE) AS value
FROM std WHERE user_id IS NOT NULL GROUP BY 1, event_type""", ("std",))
def daily_metric_by_dim(t: Tables):
    return users.daily_metric_by_dim(t.std, ["event_type"]).select(
        text("metric_date"), "name", "dimensions", "dim_hash", as_double("value"))


@query("daily_metric_by_dim_sets", """
, k AS (SELECT CAST(CAST(server_ts AS DATE) AS VARCHAR) AS metric_date, event_type, user_id,
               CAST(n % 4 AS VARCHAR) AS shard FROM std WHERE user_id IS NOT NULL),
r AS (SELECT metric_date, '{}' AS dimensions, count(DISTINCT user_id) AS u FROM k GROUP BY 1
      UNION ALL SELECT metric_date, '{"event_type":"' || event_type || '"}', count(DISTINCT user_id)
      FROM k GROUP BY 1, 2
      UNION ALL SELECT metric_date, '{"shard":"' || shard || '"}', count(DISTINCT user_id)
      FROM k GROUP BY 1, 2
      UNION ALL SELECT metric_date, '{"event_type":"' || event_type || '","shard":"' || shard || '"}',
                       count(DISTINCT user_id)
      FROM k GROUP BY 1, 2)
SELECT metric_date, 'dau' AS name, dimensions,
       CASE WHEN dimensions = '{}' THEN '' ELSE sha256(dimensions) END AS dim_hash,
       CAST(u AS DOUBLE) AS value FROM r""", ("std",))
def daily_metric_by_dim_sets(t: Tables):
    rows = t.std.withColumn("shard", (F.col("n") % 4).cast("string"))
    return users.daily_metric_by_dim_sets(
        rows, [[], ["event_type"], ["shard"], ["shard", "event_type"]]).select(
        text("metric_date"), "name", "dimensions", "dim_hash", as_double("value"))


# -- funnel ------------------------------------------------------------------------------------

_DUCK_FUNNEL = """
, k AS (SELECT count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS "view",
               count(DISTINCT CASE WHEN event_type = 'search' THEN user_id END) AS search,
               count(DISTINCT CASE WHEN event_type = 'add_to_cart' THEN user_id END)
                   AS add_to_cart,
               count(DISTINCT CASE WHEN event_type = 'order' THEN user_id END) AS "order"
        FROM std WHERE CAST(server_ts AS DATE) BETWEEN DATE '2024-01-24' AND DATE '2024-01-30')
"""
_CONV = "CASE WHEN {p} > 0 THEN (({c} * 20000 + {p}) // (2 * {p})) / 10000.0::DOUBLE END"


@query("funnel_counts", _DUCK_FUNNEL + "SELECT * FROM k", ("std",))
def funnel_counts(t: Tables):
    return funnel.funnel_counts(t.std, "2024-01-24", "2024-01-30")


@query("funnel_steps", _DUCK_FUNNEL + f"""
SELECT 1 AS step_no, 'view' AS step, "view" AS count,
       CAST(NULL AS DOUBLE) AS conversion_from_previous FROM k
UNION ALL SELECT 2, 'search', search, {_CONV.format(c='search', p='"view"')} FROM k
UNION ALL SELECT 3, 'add_to_cart', add_to_cart, {_CONV.format(c='add_to_cart', p='search')}
FROM k
UNION ALL SELECT 4, 'order', "order", {_CONV.format(c='"order"', p='add_to_cart')} FROM k""",
       ("std",))
def funnel_steps(t: Tables):
    return funnel.funnel_steps(funnel.funnel_counts(t.std, "2024-01-24", "2024-01-30"))


# -- retention ---------------------------------------------------------------------------------

@query("first_seen", """
SELECT user_id, epoch_us(min(server_ts)) AS first_us FROM std
WHERE user_id IS NOT NULL GROUP BY 1""", ("std",))
def first_seen(t: Tables):
    return retention.first_seen(t.std).select(
        "user_id", F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"))


@query("first_seen_incremental", """
SELECT user_id, epoch_us(min(server_ts)) AS first_us FROM std
WHERE user_id IS NOT NULL GROUP BY 1""", ("std",))
def first_seen_incremental(t: Tables):
    seen = retention.first_seen(t.stored)
    newer = t.std.filter(F.col("server_ts") >= F.lit("2024-01-16").cast("timestamp_ntz"))
    return retention.merge_first_seen(seen, newer).select(
        "user_id", F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"))


_DUCK_SEEN = """
, f AS (SELECT user_id, CAST(min(server_ts) AS DATE) AS d0 FROM std
        WHERE user_id IS NOT NULL GROUP BY 1),
a AS (SELECT DISTINCT user_id, CAST(server_ts AS DATE) AS d FROM std WHERE user_id IS NOT NULL),
r AS (SELECT d0, count(DISTINCT f.user_id) AS cohort_size,
             count(DISTINCT CASE WHEN d = d0 + 1 THEN f.user_id END) AS d1_retained,
             count(DISTINCT CASE WHEN d = d0 + 7 THEN f.user_id END) AS d7_retained
      FROM f JOIN a ON a.user_id = f.user_id GROUP BY 1),
s AS (SELECT CAST(d0 AS VARCHAR) AS cohort_date, cohort_size, d1_retained, d7_retained,
             ((d1_retained * 20000 + cohort_size) // (2 * cohort_size)) / 10000.0::DOUBLE
                 AS d1_rate,
             ((d7_retained * 20000 + cohort_size) // (2 * cohort_size)) / 10000.0::DOUBLE
                 AS d7_rate FROM r)
"""


def _rates(df):
    return df.select(text("cohort_date"), "cohort_size", "d1_retained", "d7_retained",
                     as_double("d1_rate"), as_double("d7_rate"))


@query("cohort_users", _DUCK_SEEN + "SELECT user_id FROM f WHERE d0 = DATE '2024-01-02'",
       ("std",))
def cohort_users(t: Tables):
    return retention.cohort_users(retention.first_seen(t.std), "2024-01-02")


@query("cohort_semi_join", _DUCK_SEEN + """
SELECT n, user_id FROM std WHERE user_id IN (
    SELECT user_id FROM f WHERE d0 = DATE '2024-01-02')""", ("std",))
def cohort_semi_join(t: Tables):
    cohort = retention.cohort_users(retention.first_seen(t.std), "2024-01-02")
    return retention.cohort_events(t.std, cohort).select("n", "user_id")


@query("retention", _DUCK_SEEN + "SELECT * FROM s WHERE cohort_date = '2024-01-02'", ("std",))
def retention_one(t: Tables):
    return _rates(retention.retention(t.std, "2024-01-02"))


@query("retention_with_first_seen", _DUCK_SEEN
       + "SELECT * FROM s WHERE cohort_date = '2024-01-02'", ("std",))
def retention_with_first_seen(t: Tables):
    seen = retention.first_seen(t.std)
    return _rates(retention.retention(t.std, "2024-01-02", seen=seen))


@query("retention_series", _DUCK_SEEN + "SELECT * FROM s", ("std",))
def retention_series(t: Tables):
    return _rates(retention.retention_series(t.std))


# -- activity and summary ----------------------------------------------------------------------

@query("events_per_minute", """
SELECT CAST(count(*) AS DOUBLE) AS events_per_minute, 60 AS window_seconds FROM std
WHERE server_ts >= (SELECT t FROM now) - INTERVAL 60 SECOND""", ("std", "now"))
def events_per_minute(t: Tables):
    return activity.events_per_minute(t.std, t.now)


@query("events_total", "SELECT count(*) AS events_total FROM std", ("std",))
def events_total(t: Tables):
    return activity.events_total(t.std)


_DUCK_SUMMARY = _DUCK_FUNNEL.rstrip() + _DUCK_SEEN + """
SELECT (SELECT count(DISTINCT user_id) FROM std
        WHERE CAST(server_ts AS DATE) = (SELECT CAST(t AS DATE) FROM now)) AS dau_today,
       (SELECT count(*) FROM std) AS events_total,
       (SELECT CAST(count(*) AS DOUBLE) FROM std
        WHERE server_ts >= (SELECT t FROM now) - INTERVAL 60 SECOND) AS events_last_minute,
       "view", search, add_to_cart, "order",
       coalesce(c.cohort_size, 0) AS cohort_size, coalesce(c.d1_retained, 0) AS d1_retained,
       coalesce(c.d7_retained, 0) AS d7_retained, coalesce(c.d1_rate, 0) AS d1_rate,
       coalesce(c.d7_rate, 0) AS d7_rate
FROM k LEFT JOIN s c ON c.cohort_date = '2024-01-22'"""


@query("metrics_summary", _DUCK_SUMMARY, ("std", "now"))
def summary(t: Tables):
    return summary_row(metrics_summary(t.std, t.now))


@query("metrics_summary_with_first_seen", _DUCK_SUMMARY, ("std", "now"))
def summary_with_first_seen(t: Tables):
    return summary_row(metrics_summary(t.std, t.now, seen=retention.first_seen(t.std)))


def summary_row(one):
    step = [F.element_at("funnel.steps", i + 1)["count"].alias(s) for i, s in enumerate(STEPS)]
    return one.select(
        "dau_today", "events_total", "events_last_minute", *step, "retention.cohort_size",
        "retention.d1_retained", "retention.d7_retained",
        as_double("retention.d1_rate", "d1_rate"), as_double("retention.d7_rate", "d7_rate"))


@query("default_windows", """
SELECT CAST(CAST(t AS DATE) AS VARCHAR) AS dau_day,
       CAST(CAST(t AS DATE) - 6 AS VARCHAR) AS funnel_start,
       CAST(CAST(t AS DATE) AS VARCHAR) AS funnel_end,
       CAST(CAST(t AS DATE) - 8 AS VARCHAR) AS cohort_date FROM now""", ("now",))
def default_windows(t: Tables):
    one = readthrough.default_windows(t.spark, t.now)
    return one.select(*[text(c) for c in one.columns])


# -- snapshot reads ----------------------------------------------------------------------------
# The reference time is 2024-01-31 12:00. Days 1-15 are stored; days 10-14 are also cached one
# minute ago and days 15-20 were cached an hour ago, which is too old.

AS_OF = "2024-01-31 12:00:00"


def dau_reads(t: Tables):
    days = t.std.select(F.to_date("server_ts").alias("metric_date")).distinct()
    stored = users.dau_series(t.std, "2024-01-01", "2024-01-15", computed_at="2024-01-15")
    cached = users.dau_series(t.std, "2024-01-10", "2024-01-20", computed_at="2024-01-30")
    age = F.when(F.col("metric_date") <= "2024-01-14", 1).otherwise(60)
    cache = cached.select(
        "metric_date", F.col("value").cast("bigint").alias("dau"), "computed_at",
        (F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(mins=age)).alias("cached_at"))
    return readthrough.read_dau(t.std, days, cache, stored, AS_OF)


_DUCK_READS = """
, reads AS (
  SELECT CAST(server_ts AS DATE) AS d, count(DISTINCT user_id) AS dau FROM std GROUP BY 1),
tagged AS (
  SELECT CAST(d AS VARCHAR) AS metric_date, dau,
         CASE WHEN d BETWEEN DATE '2024-01-10' AND DATE '2024-01-14' THEN 'cache'
              WHEN d <= DATE '2024-01-15' THEN 'database' ELSE 'computed' END AS source
  FROM reads)
"""


@query("snapshot_read_through", _DUCK_READS + """
SELECT metric_date, dau, source, source <> 'cache' AS refilled FROM tagged""", ("std",))
def snapshot_read_through(t: Tables):
    return dau_reads(t).select(text("metric_date"), "dau", "source", "refilled")


@query("read_source_ratio", _DUCK_READS + """
SELECT 'get' AS op, 'hit' AS result, count(*) FILTER (WHERE source = 'cache') AS n FROM tagged
UNION ALL SELECT 'get', 'miss', count(*) FILTER (WHERE source <> 'cache') FROM tagged
UNION ALL SELECT 'set', 'ok', count(*) FILTER (WHERE source <> 'cache') FROM tagged""",
       ("std",))
def read_source_ratio(t: Tables):
    from tidemark.operators.telemetry import read_source_ratio as ratio
    return ratio(dau_reads(t))


@query("funnel_read_through", """
, w AS (SELECT DISTINCT CAST(server_ts AS DATE) AS window_start FROM std),
x AS (SELECT window_start, window_start + 6 AS window_end FROM w)
SELECT CAST(window_start AS VARCHAR) AS window_start, CAST(window_end AS VARCHAR) AS window_end,
       count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS "view",
       count(DISTINCT CASE WHEN event_type = 'search' THEN user_id END) AS search,
       count(DISTINCT CASE WHEN event_type = 'add_to_cart' THEN user_id END) AS add_to_cart,
       count(DISTINCT CASE WHEN event_type = 'order' THEN user_id END) AS "order",
       CASE WHEN window_start <= DATE '2024-01-10' THEN 'database' ELSE 'computed' END AS source
FROM x LEFT JOIN std ON CAST(server_ts AS DATE) BETWEEN window_start AND window_end
GROUP BY 1, 2, x.window_start""", ("std",))
def funnel_read_through(t: Tables):
    """Seven-day windows from every day; those of the first ten days are stored."""
    windows = t.std.select(F.to_date("server_ts").alias("window_start")).distinct().withColumn(
        "window_end", F.date_add("window_start", 6).cast("date"))
    stored = funnel.funnel_for_windows(
        t.std, windows.filter("window_start <= '2024-01-10'")).withColumn(
        "computed_at", F.lit("2024-01-20").cast("timestamp"))
    cache = stored.filter("false").withColumn("cached_at", F.col("computed_at"))
    out = readthrough.read_funnel(t.std, windows, cache, stored, AS_OF)
    return out.select(text("window_start"), text("window_end"), *STEPS, "source")


@query("retention_read_through", _DUCK_SEEN + """
, days AS (SELECT DISTINCT CAST(server_ts AS DATE) AS d FROM std)
SELECT CAST(d AS VARCHAR) AS cohort_date, coalesce(cohort_size, 0) AS cohort_size,
       coalesce(d1_retained, 0) AS d1_retained, coalesce(d7_retained, 0) AS d7_retained,
       coalesce(d1_rate, 0) AS d1_rate, coalesce(d7_rate, 0) AS d7_rate,
       CASE WHEN cohort_size IS NOT NULL AND d <= DATE '2024-01-02' THEN 'database'
            ELSE 'computed' END AS source,
       CASE WHEN cohort_size IS NOT NULL AND d <= DATE '2024-01-02' THEN true
            ELSE d <= DATE '2024-01-23' END AS complete
FROM days LEFT JOIN s ON s.cohort_date = CAST(days.d AS VARCHAR)""", ("std",))
def retention_read_through(t: Tables):
    """Every day as a cohort; the first two are stored, later ones may be empty."""
    days = t.std.select(F.to_date("server_ts").alias("cohort_date")).distinct()
    stored = retention.retention_series(t.std).filter("cohort_date <= '2024-01-02'").withColumn(
        "computed_at", F.lit("2024-01-20").cast("timestamp"))
    cache = stored.filter("false").withColumn("cached_at", F.col("computed_at"))
    out = readthrough.read_retention(t.std, days, cache, stored, AS_OF)
    return out.select(text("cohort_date"), "cohort_size", "d1_retained", "d7_retained",
                      as_double("d1_rate"), as_double("d7_rate"), "source", "complete")


@query("epm_read_through", """
SELECT CAST(count(*) AS DOUBLE) AS events_per_minute, 60 AS window_seconds,
       'database' AS source FROM std
WHERE server_ts >= (SELECT t FROM now) - INTERVAL 60 SECOND""", ("std", "now"))
def epm_read_through(t: Tables):
    """The cached count is 31 seconds old, one more than its lifetime."""
    cache = t.std.agg(
        F.count("*").cast("double").alias("events_per_minute"),
        (F.max("server_ts") - F.make_dt_interval(secs=F.lit(31))).alias("cached_at"))
    return readthrough.read_epm(t.std, cache, t.now)


# -- stored snapshots --------------------------------------------------------------------------
# Each is read twice: the first read computes and stores what is missing, the second one finds all.

def read_twice(t: Tables, keys: list[str], read):
    path = f"{scratch(t)}/snapshots"
    first = materialize(read(path, True))
    second = read(path, False)
    return second.join(first.select(*keys, F.col("source").alias("first_source")), keys, "left")


@query("stored_dau", """
SELECT CAST(CAST(server_ts AS DATE) AS VARCHAR) AS metric_date,
       count(DISTINCT user_id) AS dau,
       CASE WHEN CAST(server_ts AS DATE) <= DATE '2024-01-15' THEN 'database' ELSE 'computed' END
           AS source,
       CASE WHEN CAST(server_ts AS DATE) <= DATE '2024-01-15' THEN 'computed' END AS first_source
FROM std GROUP BY 1, CAST(server_ts AS DATE)""", ("std",))
def stored_dau(t: Tables):
    """The first read asks for half of the days, the second one for all."""
    days = t.std.select(F.to_date("server_ts").alias("metric_date")).distinct()
    early = days.filter("metric_date <= '2024-01-15'")
    out = read_twice(t, ["metric_date"], lambda path, first: snapshots.daily_users(
        t.std, early if first else days, path, AS_OF))
    return out.select(text("metric_date"), "dau", "source", "first_source")


@query("stored_funnel", """
, w AS (SELECT DISTINCT CAST(server_ts AS DATE) AS window_start FROM std),
x AS (SELECT window_start, window_start + 6 AS window_end FROM w)
SELECT CAST(window_start AS VARCHAR) AS window_start, CAST(window_end AS VARCHAR) AS window_end,
       count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS "view",
       count(DISTINCT CASE WHEN event_type = 'search' THEN user_id END) AS search,
       count(DISTINCT CASE WHEN event_type = 'add_to_cart' THEN user_id END) AS add_to_cart,
       count(DISTINCT CASE WHEN event_type = 'order' THEN user_id END) AS "order",
       CASE WHEN window_start <= DATE '2024-01-10' THEN 'database' ELSE 'computed' END AS source,
       CASE WHEN window_start <= DATE '2024-01-10' THEN 'computed' END AS first_source
FROM x LEFT JOIN std ON CAST(server_ts AS DATE) BETWEEN window_start AND window_end
GROUP BY 1, 2, x.window_start""", ("std",))
def stored_funnel(t: Tables):
    """The first read asks for ten windows, the second one for all."""
    windows = t.std.select(F.to_date("server_ts").alias("window_start")).distinct().withColumn(
        "window_end", F.date_add("window_start", 6).cast("date"))
    out = read_twice(t, ["window_start", "window_end"], lambda path, first: snapshots.funnel_windows(
        t.std, windows.filter("window_start <= '2024-01-10'") if first else windows, path, AS_OF))
    return out.select(text("window_start"), text("window_end"), *STEPS, "source", "first_source")


@query("stored_retention", _DUCK_SEEN + """
, days AS (SELECT DISTINCT CAST(server_ts AS DATE) AS d FROM std)
SELECT CAST(d AS VARCHAR) AS cohort_date, coalesce(cohort_size, 0) AS cohort_size,
       coalesce(d1_retained, 0) AS d1_retained, coalesce(d7_retained, 0) AS d7_retained,
       coalesce(d1_rate, 0) AS d1_rate, coalesce(d7_rate, 0) AS d7_rate,
       'database' AS source, 'computed' AS first_source, d <= DATE '2024-01-23' AS complete
FROM days LEFT JOIN s ON s.cohort_date = CAST(days.d AS VARCHAR)""", ("std",))
def stored_retention(t: Tables):
    days = t.std.select(F.to_date("server_ts").alias("cohort_date")).distinct()
    seen = retention.first_seen(t.std)
    out = read_twice(t, ["cohort_date"], lambda path, _: snapshots.cohort_retention(
        t.std, seen, days, path, AS_OF))
    return out.select(text("cohort_date"), "cohort_size", "d1_retained", "d7_retained",
                      as_double("d1_rate"), as_double("d7_rate"), "source", "first_source",
                      "complete")


@query("refreshed_dau", """
, s AS (SELECT CAST(server_ts AS DATE) AS d, user_id,
               n % 5 = 0 AND CAST(server_ts AS DATE) <= DATE '2024-01-10' AS late FROM std)
SELECT CAST(d AS VARCHAR) AS metric_date, count(DISTINCT user_id) AS dau,
       count(*) FILTER (late) > 0 AS recomputed FROM s GROUP BY 1""", ("std",))
def refreshed_dau(t: Tables):
    """The second batch brings late events of ten days; the second refresh computes just those."""
    path, late = scratch(t), (F.col("n") % 5 == 0) & (F.to_date("server_ts") <= "2024-01-10")
    for i, batch in enumerate((t.std.filter(~late), t.std.filter(late))):
        tables.write_events(batch, f"{path}/events", i)
        done = snapshots.refresh_daily_users(tables.read_stored_events(t.spark, f"{path}/events"),
                                             f"{path}/snapshots", AS_OF)
    again = done.select("metric_date", F.lit(True).alias("recomputed"))
    return snapshots.refreshed_daily_users(t.spark, f"{path}/snapshots").join(
        again, "metric_date", "left").select(
        text("metric_date"), "dau", F.coalesce("recomputed", F.lit(False)).alias("recomputed"))


# -- users and lookups -------------------------------------------------------------------------

@query("users_with_role", """
SELECT u.id, u.email, r.name AS role FROM users u JOIN roles r ON r.id = u.role_id""",
       ("users", "roles"))
def users_with_role(t: Tables):
    return directory.users_with_role(t.users, t.roles).select("id", "email", "role")


@query("list_users", """
SELECT id, email FROM users ORDER BY created_at DESC, id LIMIT 50 OFFSET 20""", ("users",))
def list_users(t: Tables):
    return directory.list_users(t.users, 50, 20).select("id", "email")


@query("event_exists", """
SELECT count(*) > 0 AS found FROM std
WHERE event_id = '00000000-0000-4000-8000-000000000123'""", ("std",))
def event_exists(t: Tables):
    return activity.event_exists(t.std, "00000000-0000-4000-8000-000000000123")
