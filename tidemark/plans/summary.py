"""The dashboard summary in one pass over the events."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import scalars as S
from tidemark.operators.users import in_days, since


def metrics_summary(events: DataFrame, as_of, steps: Sequence[str] = config.FUNNEL_STEPS,
                    user_col: str = "user_id", ts_col: str = "server_ts",
                    type_col: str = "event_type", seen: DataFrame | None = None) -> DataFrame:
    """Users today, all events, events of the last minute, the funnel of the last seven days and
    the retention of the cohort of eight days ago.

    Every figure is a sum over users of something one user contributes, so one aggregate per
    user feeds them all: one scan, one shuffle of one small row per user. Anonymous events form
    the NULL group, which counts events only.

    With a first-seen table only the last nine days of events are read, and all of them are
    counted from the row counts of the files.
    """
    now = S.at(as_of)
    today = F.to_date(now)
    cohort = F.date_sub(today, 8)
    day = S.utc_day(ts_col)
    known = F.col(user_col).isNotNull()

    def flag(cond: Column) -> Column:
        return F.max(F.when(cond, 1).otherwise(0))

    in_funnel = day.between(F.date_sub(today, 6), today)
    recent = events
    if seen is not None:
        recent = since(events, F.date_sub(today, 8).cast(events.schema[ts_col].dataType), ts_col)
    per_user = recent.groupBy(user_col).agg(
        F.count("*").alias("_events"),
        F.count_if(F.col(ts_col) >= S.before(as_of, 60, "secs")).alias("_minute"),
        flag(day == today).alias("_today"),
        *[flag(in_funnel & (F.col(type_col) == s)).alias(f"_step_{s}") for s in steps],
        S.utc_day(F.min(ts_col)).alias("_first"),
        flag(day == F.date_add(cohort, 1)).alias("_d1"),
        flag(day == F.date_add(cohort, 7)).alias("_d7"),
    )
    member = known & (F.col("_first") == cohort)
    if seen is not None:
        new = in_days(seen, cohort, cohort, "first_ts").select(user_col).withColumn(
            "_new", F.lit(True))
        per_user = per_user.join(new, user_col, "left")
        member = F.coalesce(F.col("_new"), F.lit(False))

    def total(value: Column, cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0))

    sums = per_user.agg(
        total(F.col("_today"), known).alias("dau_today"),
        (F.coalesce(F.sum("_events"), F.lit(0)) if seen is None
         else events.agg(F.count("*")).scalar()).alias("events_total"),
        F.coalesce(F.sum("_minute"), F.lit(0)).cast("double").alias("events_last_minute"),
        *[total(F.col(f"_step_{s}"), known).alias(s) for s in steps],
        F.count_if(member).alias("cohort_size"),
        total(F.col("_d1"), member).alias("d1_retained"),
        total(F.col("_d7"), member).alias("d7_retained"),
    )
    rows = [
        F.struct(F.lit(s).alias("step"), F.col(s).alias("count"),
                 (S.ratio_double(F.col(s), F.col(steps[i - 1])) if i
                  else F.lit(None).cast("double")).alias("conversion_from_previous"))
        for i, s in enumerate(steps)
    ]
    size = F.col("cohort_size")
    return sums.select(
        "dau_today", "events_total", "events_last_minute",
        F.struct(F.lit("default").alias("funnel_name"),
                 F.date_sub(today, 6).alias("window_start"), today.alias("window_end"),
                 F.array(*rows).alias("steps")).alias("funnel"),
        F.struct(cohort.alias("cohort_date"), size, F.col("d1_retained"), F.col("d7_retained"),
                 S.rate_decimal(F.col("d1_retained"), size).alias("d1_rate"),
                 S.rate_decimal(F.col("d7_retained"), size).alias("d7_rate"))
        .alias("retention"),
    )
