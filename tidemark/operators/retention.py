"""First seen, cohorts, day-1 and day-7 retention."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.users import day_start, event_day, in_days, known_users


def first_seen(events: DataFrame, user_col: str = "user_id",
               ts_col: str = "server_ts") -> DataFrame:
    """First event time per known user over all history."""
    return known_users(events, user_col).groupBy(user_col).agg(F.min(ts_col).alias("first_ts"))


def merge_first_seen(stored: DataFrame, events: DataFrame, user_col: str = "user_id",
                     ts_col: str = "server_ts") -> DataFrame:
    """Bring a stored first-seen table up to date with new events, without reading history."""
    both = stored.unionByName(first_seen(events, user_col, ts_col))
    return both.groupBy(user_col).agg(F.min("first_ts").alias("first_ts"))


def cohort_users(seen: DataFrame, day, user_col: str = "user_id") -> DataFrame:
    """Users whose first event falls on the day."""
    return in_days(seen, day, day, "first_ts").select(user_col)


def cohort_events(events: DataFrame, cohort: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Events of the cohort's members."""
    return events.join(cohort.select(user_col), user_col, "left_semi")


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "d1_rate": S.rate_decimal(F.col("d1_retained"), F.col("cohort_size")),
        "d7_rate": S.rate_decimal(F.col("d7_retained"), F.col("cohort_size")),
    })


def retention(events: DataFrame, cohort_day, user_col: str = "user_id",
              ts_col: str = "server_ts", seen: DataFrame | None = None) -> DataFrame:
    """Cohort size, day-1 and day-7 returners, rates (0 for an empty cohort) of one cohort.

    Without a first-seen table, one pass over `(user, time)` finds the first event and the two
    activity days of every user together. With one, only nine days of events are read.
    """
    day = day_start(cohort_day)

    def on(n: int) -> Column:
        kind = events.schema[ts_col].dataType
        return (F.col(ts_col) >= F.date_add(day, n).cast(kind)) & (
            F.col(ts_col) < F.date_add(day, n + 1).cast(kind))

    active = [F.max(F.when(on(n), 1).otherwise(0)).alias(f"_d{n}") for n in (1, 7)]
    if seen is None:
        per_user = known_users(events, user_col).groupBy(user_col).agg(
            F.min(ts_col).alias("first_ts"), *active)
        members = in_days(per_user, cohort_day, cohort_day, "first_ts")
    else:
        members = cohort_users(seen, cohort_day, user_col)
        near = in_days(events, cohort_day, F.date_add(day, 7), ts_col)
        returned = cohort_events(near, members, user_col).groupBy(user_col).agg(*active)
        members = members.join(returned, user_col, "left")
    counts = members.agg(
        F.count("*").alias("cohort_size"),
        F.coalesce(F.sum("_d1"), F.lit(0)).alias("d1_retained"),
        F.coalesce(F.sum("_d7"), F.lit(0)).alias("d7_retained"),
    )
    return with_rates(counts.select(day.alias("cohort_date"), "*"))


def retention_for_cohorts(events: DataFrame, seen: DataFrame, cohorts: DataFrame,
                          user_col: str = "user_id", ts_col: str = "server_ts") -> DataFrame:
    """Retention of a table of `cohort_date`s, given the first-seen table.

    Reads the events of the two days on which a cohort may come back and no others. An empty cohort
    gives zeros.
    """
    wanted = cohorts.select("cohort_date").distinct()
    members = seen.select(user_col, S.utc_day("first_ts").alias("cohort_date")).join(
        wanted, "cohort_date", "left_semi")
    due = wanted.select("cohort_date", F.explode(F.array(F.lit(1), F.lit(7))).alias("_age")).select(
        "cohort_date", "_age", F.date_add("cohort_date", F.col("_age")).alias("_day"))
    active = (
        known_users(events, user_col).select(user_col, event_day(events, ts_col).alias("_day"))
        .join(due.select("_day").distinct(), "_day", "left_semi").distinct()
    )
    back = active.join(due, "_day").join(members, [user_col, "cohort_date"]).groupBy(
        "cohort_date").agg(F.count_if(F.col("_age") == 1).alias("d1_retained"),
                           F.count_if(F.col("_age") == 7).alias("d7_retained"))
    sizes = members.groupBy("cohort_date").agg(F.count("*").alias("cohort_size"))
    counts = wanted.join(sizes, "cohort_date", "left").join(back, "cohort_date", "left")
    return with_rates(counts.select("cohort_date", *[
        F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
        for c in ("cohort_size", "d1_retained", "d7_retained")]))


def retention_series(events: DataFrame, user_col: str = "user_id", ts_col: str = "server_ts",
                     as_of=None) -> DataFrame:
    """Retention of every cohort day that has members, in one pass.

    Events shrink to distinct (user, day) first; the first day is then a window minimum over at
    most one row per day and user, so there is no self join. With `as_of`, `complete` tells
    whether day 7 has passed.
    """
    days = known_users(events, user_col).select(
        user_col, event_day(events, ts_col).alias("_day")).distinct()
    age = F.datediff("_day", F.min("_day").over(Window.partitionBy(user_col)))
    counts = (
        days.withColumn("_age", age).filter(F.col("_age").isin(0, 1, 7))
        .groupBy(F.date_sub("_day", F.col("_age")).alias("cohort_date"))
        .agg(F.count_if(F.col("_age") == 0).alias("cohort_size"),
             F.count_if(F.col("_age") == 1).alias("d1_retained"),
             F.count_if(F.col("_age") == 7).alias("d7_retained"))
    )
    out = with_rates(counts)
    if as_of is None:
        return out
    return out.withColumn("complete", F.to_date(S.at(as_of)) >= F.date_add("cohort_date", 8))
