"""Message routing, redelivery and dead letters over a delivery ledger.

The ledger holds delivered, unacknowledged messages:
`(message_id, data, delivery_count, last_delivered)`.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import scalars as S
from tidemark.session import materialize


def message_order(message_id: Column | str) -> Column:
    """Sort key of a message id: plain numbers, or `<milliseconds>-<sequence>`, as numbers. Other
    ids come first, in the order of their text."""
    text = S.col(message_id).cast("string")
    return F.struct(
        F.split_part(text, F.lit("-"), F.lit(1)).try_cast("bigint").alias("ms"),
        # Only where there is one: a failing cast of '' costs more than all the rest.
        F.coalesce(F.when(text.contains("-"), F.split_part(text, F.lit("-"), F.lit(2))
                          .try_cast("bigint")), F.lit(0)).alias("seq"),
        text.alias("text"),
    )


def route_messages(classified: DataFrame,
                   max_deliveries: int = config.MAX_DELIVERIES) -> DataFrame:
    """Append `route`: good messages are written, bad ones wait or, once spent, go to dead
    letters with the verdict as `reason`."""
    bad = F.col("verdict") != "ok"
    spent = F.col("delivery_count") >= max_deliveries
    return classified.withColumns({
        "route": F.when(~bad, "write").when(spent, "dlq").otherwise("pending"),
        "reason": F.when(bad & spent, F.col("verdict")),
    })


def reclaim_stale(ledger: DataFrame, as_of, min_idle_ms: int = config.CLAIM_MIN_IDLE_MS,
                  limit: int = config.READ_BATCH) -> DataFrame:
    """Take over messages that were idle too long, oldest id first, one poll's worth."""
    idle_ms = S.epoch_ms(S.at(as_of)) - S.epoch_ms("last_delivered")
    return (
        ledger.filter(idle_ms >= min_idle_ms)
        .orderBy(message_order("message_id"))
        .limit(limit)
        .withColumns({
            "delivery_count": F.col("delivery_count") + 1,
            "last_delivered": S.at(as_of).cast(ledger.schema["last_delivered"].dataType),
        })
    )


def redeliver(ledger: DataFrame, claimed: DataFrame) -> DataFrame:
    """The ledger after a reclaim."""
    return ledger.join(claimed.select("message_id"), "message_id", "left_anti").unionByName(
        claimed.select(*ledger.columns))


def ack_messages(ledger: DataFrame, done: DataFrame) -> DataFrame:
    """Remove written and dead-lettered messages from the ledger."""
    return ledger.join(done.select("message_id"), "message_id", "left_anti")


def to_dead_letter(routed: DataFrame) -> DataFrame:
    """Dead-letter records of the routed messages: payload as it arrived, wrapped if unreadable."""
    unread = F.to_json(F.struct(F.col("data").alias("_raw"),
                                F.lit(True).alias("_parse_error")))
    payload = F.when(F.col("_parse_error"), unread).when(
        F.coalesce(F.col("data"), F.lit("")) == "", "{}").otherwise(F.col("data"))
    return routed.filter("route = 'dlq'").select(
        F.col("message_id").cast("string").alias("original_id"),
        "reason",
        F.col("delivery_count").cast("string").alias("delivery_count"),
        payload.alias("data"),
    )


def queue_stats(stream: DataFrame, ledger: DataFrame, dlq: DataFrame,
                last_delivered_id: str | int | None = None, name: str = config.STREAM_NAME,
                group: str = config.GROUP_NAME) -> DataFrame:
    """One row: kept entries, unacknowledged ones, undelivered ones, dead letters."""
    if last_delivered_id is None:
        undelivered = F.lit(None).cast("bigint")
    else:
        newer = message_order("message_id") > message_order(
            F.lit(str(last_delivered_id)))
        undelivered = F.count_if(newer)
    head = stream.agg(F.count("*").alias("length"), undelivered.alias("lag"))
    return head.select(
        F.lit(name).alias("stream"), F.lit(group).alias("group"), "length",
        ledger.agg(F.count("*")).scalar().alias("pending"), "lag",
        dlq.agg(F.count("*")).scalar().alias("dlq_length"),
    )


def batch_counts(routed: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row per poll: how many messages were written, were replays, came back, died."""
    return routed.agg(
        F.count_if(F.col("route") == "write").alias("processed"),
        F.count_if(F.col("delivery_count") > 1).alias("reclaimed"),
        F.count_if(F.col("route") == "dlq").alias("dead_lettered"),
    ).withColumn("inserted", inserted.agg(F.count("*")).scalar()).select(
        "processed", "inserted", (F.col("processed") - F.col("inserted")).alias("conflicts"),
        "reclaimed", "dead_lettered")


def retain_newest(df: DataFrame, n: int, order_col: str = "server_ts",
                  exact: bool = False) -> DataFrame:
    """Keep about the newest `n` rows and never fewer.

    Whole days are kept, newest first, until they hold `n` rows: one count per day instead of a
    global sort. `exact` keeps precisely `n`: of the oldest day that is needed only whole seconds,
    of the oldest second the last rows by time and then by the other columns, the largest first.
    """
    if not exact:
        oldest, _ = _cut(df, S.utc_day(order_col), n)
        return df.filter(S.utc_day(order_col) >= oldest)
    second = F.coalesce(F.unix_seconds(F.col(order_col).cast("timestamp")),
                        F.lit(-2 ** 40)).alias("_second")
    rows = df.withColumn("_second", second)
    day = F.floor(F.col("_second") / 86_400)
    cut_day, after_day = _cut(rows, day, n)
    cut_second, newer = _cut(rows.filter(day == cut_day), F.col("_second"), n - after_day)
    border = _last_rows(rows.filter(F.col("_second") == cut_second), n - after_day - newer, order_col,
                        [c for c in df.columns if c != order_col])
    return rows.filter(F.col("_second") > cut_second).unionByName(border).drop("_second")


def _last_rows(df: DataFrame, n: Column, order_col: str, rest: list[str]) -> DataFrame:
    """The last `n` rows by time and then by the other columns, without one task that sees them all.

    Rows are dealt out in order and written, as their place must not change; equal ones are told apart
    by a number. The rows in earlier parts, one count per part, and the place in its own part give the
    rank.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(order_col).desc_nulls_last(),
             *[F.col(c).cast("string").desc_nulls_last() for c in rest], F.col("_copy")]
    dealt = materialize(
        df.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(parts, *order)
        .withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_part").agg(F.count("*").alias("_rows")).withColumn(
        "_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).filter(F.col("_before") < n)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    ranked = dealt.join(before.drop("_rows"), "_part").withColumn("_n", F.col("_before") + place)
    return ranked.filter(F.col("_n") <= n).select(*df.columns)


def _cut(df: DataFrame, slot: Column, n) -> tuple[Column, Column]:
    """The oldest time slot that the newest `n` rows reach into, and the rows in newer slots.

    One row per slot is ordered in one task; slots are days, or the seconds of one day.
    """
    per_slot = df.groupBy(slot.alias("_slot")).agg(F.count("*").alias("_rows"))
    newer = Window.orderBy(F.col("_slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    kept = per_slot.withColumn("_newer", F.coalesce(F.sum("_rows").over(newer), F.lit(0))).filter(
        F.col("_newer") < n)
    return (kept.agg(F.min("_slot")).scalar(),
            F.coalesce(kept.agg(F.max("_newer")).scalar(), F.lit(0)))
