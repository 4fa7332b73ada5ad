"""Snapshot reads: cache first, stored row second, computation last."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import scalars as S
from tidemark.operators import funnel, retention, users
from tidemark.operators.activity import events_per_minute


def default_windows(spark: SparkSession, as_of) -> DataFrame:
    """Default day, funnel window and cohort of a reference time, one row.

    The cohort lies eight days back, so that its day 7 is complete.
    """
    today = F.to_date(S.at(as_of))
    return spark.range(1).select(
        today.alias("dau_day"),
        F.date_sub(today, 6).alias("funnel_start"), today.alias("funnel_end"),
        F.date_sub(today, 8).alias("cohort_date"),
    )


def read_through(requested: DataFrame, cache: DataFrame, stored: DataFrame,
                 compute: Callable[[DataFrame], DataFrame], keys: str | Sequence[str],
                 values: Sequence[str], ttl_seconds: int, as_of,
                 max_age_seconds: int | None = None, refill_stored: bool = False) -> DataFrame:
    """Answer every requested key and say where the answer came from.

    `cache` has keys, values, `computed_at`, `cached_at`; an entry counts while it is younger
    than the lifetime. `stored` has keys, values, `computed_at` and no age limit unless
    `max_age_seconds` is given. `compute` gets the remaining keys and returns keys and values.
    `refilled` marks answers that go (back) into the cache: computed ones, and stored ones if
    `refill_stored`.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    now = S.at(as_of)
    shown = [*keys, *values, "computed_at"]
    live = cache.filter(F.col("cached_at") > S.before(as_of, ttl_seconds, "secs"))
    if max_age_seconds is not None:
        stored = stored.filter(
            F.col("computed_at") > S.before(as_of, max_age_seconds, "secs"))
    hits = requested.join(live.select(*shown), keys).withColumn("source", F.lit("cache"))
    rest = requested.join(live.select(*keys), keys, "left_anti")
    found = rest.join(stored.select(*shown), keys).withColumn("source", F.lit("database"))
    missing = rest.join(stored.select(*keys), keys, "left_anti")
    fresh = (
        compute(missing).select(*keys, *values)
        .withColumn("computed_at", now.cast(stored.schema["computed_at"].dataType))
        .withColumn("source", F.lit("computed"))
    )
    refilled = F.col("source") == "computed"
    if refill_stored:
        refilled = refilled | (F.col("source") == "database")
    return hits.select(*shown, "source").unionByName(found.select(*shown, "source")).unionByName(
        fresh.select(*shown, "source")).withColumn("refilled", refilled)


def read_dau(events: DataFrame, requested: DataFrame, cache: DataFrame, stored: DataFrame,
             as_of, user_col: str = "user_id", ts_col: str = "server_ts") -> DataFrame:
    """Active users of the requested `metric_date`s. Stored rows refill the cache. Rows that
    carry dimensions belong to other metrics and are not looked at."""
    plain = stored.filter("name = 'dau' AND dim_hash = ''").select(
        "metric_date", F.col("value").cast("bigint").alias("dau"), "computed_at")
    return read_through(
        requested, cache, plain, lambda days: users.dau_for_days(events, days, user_col, ts_col),
        "metric_date", ["dau"], config.CACHE_TTL["dau"], as_of, refill_stored=True)


def read_funnel(events: DataFrame, requested: DataFrame, cache: DataFrame, stored: DataFrame,
                as_of, steps: Sequence[str] = config.FUNNEL_STEPS, user_col: str = "user_id",
                ts_col: str = "server_ts") -> DataFrame:
    """Step counts of the requested `(window_start, window_end)` rows."""
    return read_through(
        requested, cache, stored,
        lambda w: funnel.funnel_for_windows(events, w, steps, user_col, ts_col),
        ["window_start", "window_end"], list(steps), config.CACHE_TTL["funnel"], as_of)


def read_retention(events: DataFrame, requested: DataFrame, cache: DataFrame,
                   stored: DataFrame, as_of, user_col: str = "user_id",
                   ts_col: str = "server_ts") -> DataFrame:
    """Retention of the requested `cohort_date`s; an empty cohort gives zeros."""
    values = ["cohort_size", "d1_retained", "d7_retained", "d1_rate", "d7_rate"]

    def compute(missing: DataFrame) -> DataFrame:
        series = retention.retention_series(events, user_col, ts_col)
        return missing.join(series, "cohort_date", "left").select(
            "cohort_date", *[F.coalesce(v, F.lit(0)).cast(series.schema[v].dataType).alias(v)
                             for v in values])

    out = read_through(requested, cache, stored, compute, "cohort_date", values,
                       config.CACHE_TTL["retention"], as_of)
    return out.withColumn("complete", F.to_date("computed_at") >= F.date_add("cohort_date", 8))


def read_epm(events: DataFrame, cache: DataFrame, as_of,
             ts_col: str = "server_ts") -> DataFrame:
    """Events of the last minute, from the cache (`events_per_minute`, `cached_at`) while it is
    fresh, else counted."""
    ttl = config.CACHE_TTL["realtime"]
    live = cache.filter(F.col("cached_at") > S.before(as_of, ttl, "secs"))
    kept = live.agg(F.max_by("events_per_minute", "cached_at")).scalar()
    return events_per_minute(events, as_of, ts_col).select(
        F.coalesce(kept, "events_per_minute").alias("events_per_minute"), "window_seconds",
        F.when(kept.isNotNull(), "cache").otherwise("database").alias("source"))
