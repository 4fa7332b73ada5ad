"""Stored metric snapshots: answer what is stored, compute the rest from the events and store it.

Three tables: daily metrics, funnel windows, cohort retention. Without missing keys no event file is
read. Missing keys read the days they need only.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config, schemas
from tidemark.functions import scalars as S
from tidemark.operators import funnel, retention, users
from tidemark.session import materialize
from tidemark.sources import tables


def read_or_store(requested: DataFrame, path: str, schema: T.StructType, keys: Sequence[str],
                  compute: Callable[[DataFrame], DataFrame], as_of) -> DataFrame:
    """The stored rows of all requested keys, with `source`: `database`, or `computed` for those
    that were computed and stored by this call. Keys without an answer do not come back."""
    spark = requested.sparkSession
    keys = list(keys)
    wanted = materialize(requested.select(*keys).distinct())
    stored = tables.read_snapshot(spark, path, schema)
    missing = wanted.join(stored.select(*keys), keys, "left_anti")
    fresh = None
    if not missing.isEmpty():
        rows = compute(missing).withColumn("computed_at", S.at(as_of).cast("timestamp"))
        fresh = materialize(rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]))
        stored = tables.upsert_snapshot(spark, path, fresh, keys)
    found = wanted.join(stored, keys)
    if fresh is None:
        return found.withColumn("source", F.lit("database"))
    marked = fresh.select(*keys, F.lit("computed").alias("_made"))
    return found.join(marked, keys, "left").withColumn(
        "source", F.coalesce("_made", F.lit("database"))).drop("_made")


def daily_users(events: DataFrame, days: DataFrame, path: str, as_of, user_col: str = "user_id",
                ts_col: str = "server_ts") -> DataFrame:
    """Active users of the requested `metric_date`s: `metric_date, dau, computed_at, source`."""
    keys = ["metric_date", "name", "dim_hash"]
    asked = days.select("metric_date", F.lit("dau").alias("name"), F.lit("").alias("dim_hash"))

    def compute(missing: DataFrame) -> DataFrame:
        counted = users.dau_for_days(events, missing, user_col, ts_col)
        return users.as_daily_metric(counted, "dau", "dau", as_of).drop("computed_at")

    out = read_or_store(asked, path, schemas.DAILY_METRICS, keys, compute, as_of)
    return out.select("metric_date", F.col("value").cast("bigint").alias("dau"), "computed_at",
                      "source")


def funnel_windows(events: DataFrame, windows: DataFrame, path: str, as_of,
                   steps: Sequence[str] = config.FUNNEL_STEPS, user_col: str = "user_id",
                   ts_col: str = "server_ts") -> DataFrame:
    """Step counts of the requested `(window_start, window_end)` rows."""
    return read_or_store(
        windows, path, schemas.funnel_snapshots(steps), ["window_start", "window_end"],
        lambda missing: funnel.funnel_for_windows(events, missing, steps, user_col, ts_col), as_of)


def cohort_retention(events: DataFrame, seen: DataFrame, cohorts: DataFrame, path: str, as_of,
                     user_col: str = "user_id", ts_col: str = "server_ts") -> DataFrame:
    """Retention of the requested `cohort_date`s, from the first-seen table and the two days a
    cohort may come back on; an empty cohort gives zeros. `complete` tells whether day 7 had passed
    when it was computed."""
    out = read_or_store(
        cohorts, path, schemas.RETENTION_SNAPSHOTS, ["cohort_date"],
        lambda missing: retention.retention_for_cohorts(events, seen, missing, user_col, ts_col),
        as_of)
    return out.withColumn("complete", F.to_date("computed_at") >= F.date_add("cohort_date", 8))


MARKS = T.StructType([T.StructField("name", T.StringType()), T.StructField("stream", T.StringType()),
                      T.StructField("batch_id", T.LongType())])


def late_days(stored: DataFrame, marks: DataFrame, name: str) -> DataFrame:
    """The days of all batches of the event table that a snapshot has not seen: `metric_date`. Reads
    the folder columns of newer batches only."""
    seen = marks.filter(F.col("name") == name).select("stream", F.col("batch_id").alias("_seen"))
    fresh = stored.select("stream", "batch_id", "event_date").join(seen, "stream", "left").filter(
        F.col("_seen").isNull() | (F.col("batch_id") > F.col("_seen")))
    return fresh.select(F.col("event_date").alias("metric_date")).distinct()


def refresh_daily_users(stored: DataFrame, path: str, as_of, user_col: str = "user_id",
                        name: str = "dau") -> DataFrame:
    """Bring the stored daily users up to date with the event table `stored` (`read_stored_events`):
    the days that batches since the last refresh have events on are computed anew, late events or not,
    and no other day. Returns these days as `metric_date, dau`.

    The newest batch of each stream is noted after the days are stored, so a refresh that fails is
    made up for by the next one.
    """
    spark = stored.sparkSession
    marks_path, table = f"{path}/{name}-marks", f"{path}/{name}"
    marks = tables.read_snapshot(spark, marks_path, MARKS)
    # Fixed before the days are counted: a batch that arrives meanwhile is left to the next refresh.
    newest = materialize(stored.groupBy("stream").agg(F.max("batch_id").alias("batch_id")).select(
        F.lit(name).alias("name"), "stream", "batch_id"))
    now = newest.select("stream", F.col("batch_id").alias("_now"))
    upto = stored.join(now, "stream").filter(F.col("batch_id") <= F.col("_now"))
    days = materialize(late_days(upto, marks, name))
    counted = users.dau_for_days(upto, days, user_col)
    rows = users.as_daily_metric(counted, name, "dau", as_of).withColumn(
        "computed_at", F.col("computed_at").cast("timestamp"))
    fresh = materialize(rows.select(*[F.col(f.name).cast(f.dataType)
                                      for f in schemas.DAILY_METRICS.fields]))
    if not fresh.isEmpty():
        tables.upsert_snapshot(spark, table, fresh, ["metric_date", "name", "dim_hash"])
        tables.upsert_snapshot(spark, marks_path, newest, ["name", "stream"])
    return fresh.select("metric_date", F.col("value").cast("bigint").alias("dau"))


def refreshed_daily_users(spark: SparkSession, path: str, name: str = "dau") -> DataFrame:
    """All stored days: `metric_date, dau, computed_at`."""
    return tables.read_snapshot(spark, f"{path}/{name}", schemas.DAILY_METRICS).select(
        "metric_date", F.col("value").cast("bigint").alias("dau"), "computed_at")
