"""Daily active users, exact and by sketch, trailing activity, dimensioned daily metrics."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import scalars as S


def known_users(df: DataFrame, user_col: str = "user_id") -> DataFrame:
    return df.filter(F.col(user_col).isNotNull())


def day_start(day) -> Column:
    return (F.lit(day) if not isinstance(day, Column) else day).cast("date")


def event_day(df: DataFrame, ts_col: str = "server_ts") -> Column:
    """The UTC day of an event. The event table keeps it as partition column, which then spares
    the read of the time column and lets a join on days prune folders."""
    if ts_col == "server_ts" and "event_date" in df.columns:
        return F.col("event_date")
    return S.utc_day(ts_col)


def in_days(df: DataFrame, start, end, ts_col: str = "server_ts") -> DataFrame:
    """Rows from `start` through `end`, both UTC days, the end day included.

    A plain range on the time column reaches the scan; a date-partitioned table also gets the
    range on its partition column.
    """
    lo, hi = day_start(start), day_start(end)
    kind = df.schema[ts_col].dataType
    out = df.filter((F.col(ts_col) >= lo.cast(kind))
                    & (F.col(ts_col) < F.date_add(hi, 1).cast(kind)))
    if ts_col == "server_ts" and "event_date" in df.columns:
        out = out.filter(F.col("event_date").between(lo, hi))
    return out


def since(df: DataFrame, bound: Column, ts_col: str = "server_ts") -> DataFrame:
    """Rows at or after a time; the event table also drops the day folders before it."""
    out = df.filter(F.col(ts_col) >= bound)
    if ts_col == "server_ts" and "event_date" in df.columns:
        out = out.filter(F.col("event_date") >= F.to_date(bound))
    return out


def dau(events: DataFrame, day, user_col: str = "user_id",
        ts_col: str = "server_ts") -> DataFrame:
    """Distinct known users of one day; 0 when there are none."""
    return in_days(events, day, day, ts_col).agg(
        F.count_distinct(user_col).alias("dau")
    ).select(day_start(day).alias("metric_date"), "dau")


def users_per_day(events: DataFrame, user_col: str = "user_id",
                  ts_col: str = "server_ts") -> DataFrame:
    return (
        known_users(events, user_col)
        .groupBy(event_day(events, ts_col).alias("metric_date"))
        .agg(F.count_distinct(user_col).alias("dau"))
    )


def as_daily_metric(df: DataFrame, name: str, value_col: str, computed_at=None) -> DataFrame:
    """Rows in the shape of the daily snapshot table, without dimensions."""
    now = F.current_timestamp() if computed_at is None else S.at(computed_at)
    return df.select(
        "metric_date", F.lit(name).alias("name"), F.lit("{}").alias("dimensions"),
        F.lit("").alias("dim_hash"), F.col(value_col).cast("decimal(20,4)").alias("value"),
        now.alias("computed_at"),
    )


def dau_for_days(events: DataFrame, days: DataFrame, user_col: str = "user_id",
                 ts_col: str = "server_ts", day_col: str = "metric_date") -> DataFrame:
    """Active users for a table of days; a day without events gives 0."""
    wanted = days.select(F.col(day_col).alias("metric_date"))
    hits = (
        known_users(events, user_col)
        .select(event_day(events, ts_col).alias("metric_date"), user_col)
        .join(wanted, "metric_date", "left_semi")
        .groupBy("metric_date").agg(F.count_distinct(user_col).alias("dau"))
    )
    return wanted.join(hits, "metric_date", "left").select(
        F.col("metric_date").alias(day_col), F.coalesce("dau", F.lit(0)).alias("dau"))


def dau_series(events: DataFrame, start, end, user_col: str = "user_id",
               ts_col: str = "server_ts", computed_at=None) -> DataFrame:
    """Active users for every day of a range, as daily snapshot rows."""
    spark = events.sparkSession
    days = spark.range(1).select(
        F.explode(F.sequence(day_start(start), day_start(end))).alias("metric_date"))
    counted = users_per_day(in_days(events, start, end, ts_col), user_col, ts_col)
    full = days.join(counted, "metric_date", "left").withColumn(
        "dau", F.coalesce("dau", F.lit(0)))
    return as_daily_metric(full, "dau", "dau", computed_at)


def dau_sketches(events: DataFrame, user_col: str = "user_id", ts_col: str = "server_ts",
                 lg_k: int = config.HLL_LG_K) -> DataFrame:
    """One mergeable distinct-user sketch per day."""
    return (
        known_users(events, user_col)
        .groupBy(event_day(events, ts_col).alias("metric_date"))
        .agg(F.hll_sketch_agg(F.col(user_col).cast("string"), F.lit(lg_k)).alias("sketch"),
             F.max(ts_col).alias("updated_at"))
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ("metric_date",)) -> DataFrame:
    return sketches.groupBy(*by).agg(
        F.hll_union_agg("sketch").alias("sketch"), F.max("updated_at").alias("updated_at"))


def dau_estimate(sketches: DataFrame, by: Sequence[str] = ("metric_date",)) -> DataFrame:
    """Approximate distinct users per group of sketches; an empty `by` merges them all."""
    return merge_sketches(sketches, by).select(
        *by, F.hll_sketch_estimate("sketch").alias("dau_estimate"))


def expire_sketches(sketches: DataFrame, as_of,
                    ttl_days: int = config.SKETCH_TTL_DAYS) -> DataFrame:
    """Keep the sketches that were updated within the last days."""
    return sketches.filter(F.col("updated_at") > S.before(as_of, ttl_days, "days"))


def active_users(events: DataFrame, as_of, hours: int = 24, user_col: str = "user_id",
                 ts_col: str = "server_ts") -> DataFrame:
    """Distinct known users of the trailing hours."""
    return since(events, S.before(as_of, hours, "hours"), ts_col).agg(
        F.count_distinct(user_col).alias("active_users"))


def daily_metric_by_dim(events: DataFrame, dims: Sequence[str], name: str = "dau",
                        user_col: str = "user_id", ts_col: str = "server_ts",
                        computed_at=None) -> DataFrame:
    """Distinct users per day and dimension values, as daily snapshot rows.

    `dimensions` is JSON with sorted keys and `dim_hash` its SHA-256, so one combination has
    one key.
    """
    now = F.current_timestamp() if computed_at is None else S.at(computed_at)
    text = F.to_json(F.struct(*[F.col(d) for d in sorted(dims)]), {"ignoreNullFields": "false"})
    return (
        known_users(events, user_col)
        .groupBy(event_day(events, ts_col).alias("metric_date"), *dims)
        .agg(F.count_distinct(user_col).alias("_users"))
        .select("metric_date", F.lit(name).alias("name"), text.alias("dimensions"),
                F.sha2(text, 256).alias("dim_hash"),
                F.col("_users").cast("decimal(20,4)").alias("value"), now.alias("computed_at"))
    )


def daily_metric_by_dim_sets(events: DataFrame, dim_sets: Sequence[Sequence[str]],
                             name: str = "dau", user_col: str = "user_id",
                             ts_col: str = "server_ts", computed_at=None) -> DataFrame:
    """`daily_metric_by_dim` for several sets of dimensions in one scan; an empty set is the plain
    metric, with `{}` and an empty `dim_hash`.

    Events shrink to one row per day, user and combination of all dimensions first. Only those rows
    are repeated per set, and reduced to one per user again before they are counted.
    """
    sets = [sorted(s) for s in dict.fromkeys(tuple(sorted(s)) for s in dim_sets)]
    dims = sorted({d for s in sets for d in s})
    now = F.current_timestamp() if computed_at is None else S.at(computed_at)
    rows = known_users(events, user_col).select(
        event_day(events, ts_col).alias("metric_date"), F.col(user_col).alias("_user"),
        *dims).distinct()
    keys = ["metric_date", "_user"]
    # The bits of the grouping id, from the left: columns that a set leaves out.
    ids = {sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in s): s for s in sets}
    per_user = rows.groupingSets(
        [[F.col(c) for c in (*keys, *s)] for s in sets],
        *[F.col(c) for c in (*keys, *dims)]).agg(F.grouping_id().cast("bigint").alias("_set"))
    counted = per_user.groupBy("metric_date", "_set", *dims).agg(F.count("*").alias("_users"))
    text = F.lit("{}")
    for number, s in ids.items():
        if s:
            json = F.to_json(F.struct(*[F.col(d) for d in s]), {"ignoreNullFields": "false"})
            text = F.when(F.col("_set") == number, json).otherwise(text)
    whole = F.col("_set") == (1 << len(dims)) - 1 if dims else F.lit(True)
    return counted.withColumn("dimensions", text).select(
        "metric_date", F.lit(name).alias("name"), "dimensions",
        F.when(whole, "").otherwise(F.sha2("dimensions", 256)).alias("dim_hash"),
        F.col("_users").cast("decimal(20,4)").alias("value"), now.alias("computed_at"))
