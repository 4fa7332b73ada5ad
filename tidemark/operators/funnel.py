"""Step funnels: independent distinct users per step, conversions between steps."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import scalars as S
from tidemark.operators.users import event_day, in_days, known_users


def _flags(steps: Sequence[str], type_col: str) -> list:
    return [F.max(F.when(F.col(type_col) == s, 1).otherwise(0)).alias(s) for s in steps]


def funnel_counts(events: DataFrame, start, end, steps: Sequence[str] = config.FUNNEL_STEPS,
                  user_col: str = "user_id", ts_col: str = "server_ts",
                  type_col: str = "event_type") -> DataFrame:
    """One row, one column per step: distinct users with that event type in the window.

    Steps are independent of each other and of order. One flag per user and step, then a sum:
    one scan and one shuffle, and no row is multiplied per step.
    """
    per_user = (
        known_users(in_days(events, start, end, ts_col), user_col)
        .filter(F.col(type_col).isin(*steps))
        .groupBy(user_col).agg(*_flags(steps, type_col))
    )
    return per_user.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in steps])


def funnel_steps(counts: DataFrame, steps: Sequence[str] = config.FUNNEL_STEPS) -> DataFrame:
    """Counts as one row per step with the conversion from the previous step.

    The conversion is NULL for the first step or an empty previous one, and may exceed 1.
    """
    kept = [c for c in counts.columns if c not in steps]

    def conversion(i: int):
        if i == 0:
            return F.lit(None).cast("double")
        return S.ratio_double(F.col(steps[i]), F.col(steps[i - 1]))

    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("step_no"), F.lit(s).alias("step"),
                 F.col(s).alias("count"),
                 conversion(i).alias("conversion_from_previous"))
        for i, s in enumerate(steps)
    ])
    return counts.select(*kept, F.inline(rows))


def funnel_for_windows(events: DataFrame, windows: DataFrame,
                       steps: Sequence[str] = config.FUNNEL_STEPS, user_col: str = "user_id",
                       ts_col: str = "server_ts", type_col: str = "event_type") -> DataFrame:
    """Counts for many `(window_start, window_end)` rows in one scan.

    Only the days of the windows are read. Events are reduced to one row per user and day; the
    windows are spelled out as days, so the match is an equality on the day. Windows without events give zeros.
    """
    keys = ["window_start", "window_end"]
    days = windows.select(
        *keys, F.explode(F.sequence("window_start", "window_end")).alias("_day"))
    per_day = (
        known_users(events, user_col).filter(F.col(type_col).isin(*steps))
        .withColumn("_day", event_day(events, ts_col))
        .join(days.select("_day").distinct(), "_day", "left_semi")
        .groupBy("_day", user_col).agg(*_flags(steps, type_col))
    )
    counted = (
        per_day.join(days, "_day")
        .groupBy(*keys, user_col).agg(*[F.max(s).alias(s) for s in steps])
        .groupBy(*keys).agg(*[F.sum(s).alias(s) for s in steps])
    )
    return windows.select(*keys).join(counted, keys, "left").na.fill(0, list(steps))
