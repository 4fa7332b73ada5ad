"""Live metrics over a stream of events. The event time is `server_ts`.

The watermark equals the replay window of one day. Late rows still reach the event table through
the writer; only these boards ignore them. Boards use update mode, because append mode holds a
window back until the watermark has passed it.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import config
from tidemark.operators import sketches
from tidemark.operators.users import known_users
from tidemark.sources import tables

WATERMARK = "24 hours"


def dedup_stream(stream: DataFrame, ttl: str = f"{config.CLAIM_TTL_SECONDS} seconds",
                 key: str = "event_id", ts_col: str = "server_ts") -> DataFrame:
    """Drop replays that arrive within the claim time. State is forgotten after it, so the
    stored-id check of the writer stays the last guard."""
    return stream.withWatermark(ts_col, ttl).dropDuplicatesWithinWatermark([key])


def _one_per_user(stream: DataFrame, extra: Sequence[str], user_col: str,
                  ts_col: str) -> DataFrame:
    """One row per user, UTC day and extra key; state ends with the watermark."""
    return (
        known_users(stream, user_col).withWatermark(ts_col, WATERMARK)
        .withColumn("day", F.window(ts_col, "1 day"))
        .dropDuplicates(["day", *extra, user_col])
    )


def stream_dau(stream: DataFrame, exact: bool = True, user_col: str = "user_id",
               ts_col: str = "server_ts") -> DataFrame:
    """Active users per UTC day: exact by state per user and day, or one sketch per day."""
    if exact:
        counted = _one_per_user(stream, [], user_col, ts_col).groupBy("day").agg(
            F.count("*").alias("dau"))
    else:
        sketch = F.hll_sketch_agg(F.col(user_col).cast("string"), F.lit(config.HLL_LG_K))
        counted = (
            known_users(stream, user_col).withWatermark(ts_col, WATERMARK)
            .groupBy(F.window(ts_col, "1 day").alias("day"))
            .agg(F.hll_sketch_estimate(sketch).alias("dau"))
        )
    return counted.select(F.to_date("day.start").alias("metric_date"), "dau")


def stream_epm(stream: DataFrame, ts_col: str = "server_ts", window: str = "60 seconds",
               slide: str = "10 seconds") -> DataFrame:
    """Events per minute in sliding windows, anonymous events included."""
    return (
        stream.withWatermark(ts_col, WATERMARK)
        .groupBy(F.window(ts_col, window, slide).alias("w")).agg(F.count("*").alias("n"))
        .select(F.to_date("w.start").alias("window_date"),
                F.col("w.start").alias("window_start"),
                F.col("n").cast("double").alias("events_per_minute"))
    )


def stream_funnel(stream: DataFrame, steps: Sequence[str] = config.FUNNEL_STEPS,
                  user_col: str = "user_id", ts_col: str = "server_ts",
                  type_col: str = "event_type") -> DataFrame:
    """Distinct users per UTC day and step."""
    wanted = stream.filter(F.col(type_col).isin(*steps))
    return (
        _one_per_user(wanted, [type_col], user_col, ts_col)
        .groupBy("day", type_col).agg(F.count("*").alias("users"))
        .select(F.to_date("day.start").alias("metric_date"), F.col(type_col).alias("step"),
                "users")
    )


def stream_latency(stream: DataFrame, ts_col: str = "ts", window: str = "5 minutes") -> DataFrame:
    """A latency sketch per window, method and normalised path, kept up to date; `latency_report` reads
    quantiles of any range from the board."""
    timed = stream.withWatermark(ts_col, WATERMARK).withColumnRenamed(ts_col, "ts")
    return sketches.latency_sketches(timed, window).withColumn("window_date", F.to_date("at"))


def run_board(board: DataFrame, path: str, keys: str | Sequence[str], checkpoint: str,
              once: bool = False, every: str = "5 seconds",
              day_col: str | None = None) -> StreamingQuery:
    """Keep a snapshot table up to date with a live metric. A repeated batch upserts the same
    rows again.

    Boards with few rows per day are rewritten as a whole; `day_col` keeps a folder per day and
    rewrites only the days that changed.
    """
    def publish(batch: DataFrame, _: int) -> None:
        if day_col is None:
            tables.upsert_snapshot(batch.sparkSession, path, batch, keys)
        else:
            tables.upsert_by_day(batch.sparkSession, path, batch, keys, day_col)

    trigger = {"availableNow": True} if once else {"processingTime": every}
    return (
        board.writeStream.outputMode("update").foreachBatch(publish)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
