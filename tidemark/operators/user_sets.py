"""Exact distinct users over any set of days, from stored bitmaps.

Every user has a dense number that is given once. A bitmap holds 32,768 of them in 4 KB; there is one
per day, event type and block of numbers. Distinct users of any days are the bits of the bitmaps put
together by `or`, so a week or a funnel is answered without its events, and exactly. Adding a batch
again sets the same bits.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators.users import event_day, known_users
from tidemark.session import materialize


def number_new(events: DataFrame, numbers: DataFrame, user_col: str = "user_id") -> DataFrame:
    """`(user, number)` for the known users of the events that have none in `numbers` yet, counted on
    from the largest number there. Written to the shared folder, so that a number once read stays.

    Numbers are given in all tasks at once: the users in earlier parts, one count per part, and the
    place in the own part.
    """
    fresh = known_users(events, user_col).select(user_col).distinct().join(
        numbers.select(user_col), user_col, "left_anti")
    dealt = materialize(fresh.withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_part").agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    last = F.coalesce(numbers.agg(F.max("number")).scalar(), F.lit(0).cast("bigint"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(user_col))
    return materialize(dealt.join(before, "_part").select(
        user_col, (last + F.col("_before") + place).cast("bigint").alias("number")))


def user_bitmaps(events: DataFrame, numbers: DataFrame, user_col: str = "user_id",
                 ts_col: str = "server_ts", type_col: str = "event_type") -> DataFrame:
    """metric_date, event type, block, bitmap of the known users. Events shrink to one row per day,
    type and user before they meet the numbers."""
    active = known_users(events, user_col).select(
        event_day(events, ts_col).alias("metric_date"), F.col(type_col).alias("event_type"),
        user_col).distinct()
    return active.join(numbers, user_col).groupBy(
        "metric_date", "event_type", F.bitmap_bucket_number("number").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))


def merge_bitmaps(bitmaps: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """One bitmap per group and block: the users of all its rows."""
    return bitmaps.groupBy(*by, "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def count_users(bitmaps: DataFrame, by: Sequence[str], name: str = "users") -> DataFrame:
    """Distinct users per group."""
    return merge_bitmaps(bitmaps, by).groupBy(*by).agg(
        F.sum(F.bitmap_count("bitmap")).cast("bigint").alias(name))


def _of_windows(bitmaps: DataFrame, windows: DataFrame) -> DataFrame:
    days = windows.select("window_start", "window_end", F.explode(
        F.sequence("window_start", "window_end")).alias("metric_date"))
    return bitmaps.join(days, "metric_date")


def users_of_windows(bitmaps: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct users of every `(window_start, window_end)`, both days included; 0 when there are
    none."""
    keys = ["window_start", "window_end"]
    counted = count_users(_of_windows(bitmaps, windows), keys)
    return windows.select(*keys).join(counted, keys, "left").na.fill(0, ["users"])


def funnel_of_windows(bitmaps: DataFrame, windows: DataFrame,
                      steps: Sequence[str] = config.FUNNEL_STEPS) -> DataFrame:
    """Distinct users per step of every window, one column per step, as `funnel_for_windows`."""
    keys = ["window_start", "window_end"]
    wanted = bitmaps.filter(F.col("event_type").isin(*steps))
    counted = count_users(_of_windows(wanted, windows), [*keys, "event_type"])
    wide = counted.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("event_type") == s, F.col("users"))).alias(s) for s in steps])
    return windows.select(*keys).join(wide, keys, "left").na.fill(0, list(steps))
