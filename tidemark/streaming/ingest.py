"""The writer as a stream: messages in, events, dead letters, sketches and counts out.

Every message ends in one of four places: it is stored as an event, it is a replay, it is a dead
letter, or it waits in the retry table, which is read together with the next batch.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark import config
from tidemark.operators import contract, dedup, reliability, users
from tidemark.session import delete_folder
from tidemark.sources import batches, keys, tables
from tidemark.sources.batches import ADDRESS, Batch, as_batch

DEAD_LETTERS = T.StructType([
    T.StructField("original_id", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("delivery_count", T.StringType()),
    T.StructField("data", T.StringType()),
    *ADDRESS,
])
RETRY = T.StructType([
    T.StructField("message_id", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("delivery_count", T.IntegerType()),
    T.StructField("arrival_ts", T.TimestampType()),
    T.StructField("topic_partition", T.IntegerType()),
    T.StructField("topic_offset", T.LongType()),
])
SKETCHES = T.StructType([
    T.StructField("metric_date", T.DateType()),
    T.StructField("sketch", T.BinaryType()),
    T.StructField("updated_at", T.TimestampType()),
    *ADDRESS,
])
COUNTS = T.StructType([
    *[T.StructField(n, T.LongType())
      for n in ("processed", "inserted", "conflicts", "reclaimed", "dead_lettered", "pending")],
    *ADDRESS,
])


@dataclass(frozen=True)
class IngestTables:
    """Folders of the writer's output tables."""

    root: str

    @property
    def events(self) -> str:
        return f"{self.root}/events"

    @property
    def dead_letters(self) -> str:
        return f"{self.root}/dead_letters"

    @property
    def sketches(self) -> str:
        return f"{self.root}/dau_sketches"

    @property
    def retry(self) -> str:
        return f"{self.root}/retry"

    @property
    def keys(self) -> str:
        return f"{self.root}/event_keys"

    @property
    def staging(self) -> str:
        return f"{self.root}/staging"

    @property
    def counts(self) -> str:
        return f"{self.root}/write_counts"


def waiting(spark: SparkSession, out: IngestTables, batch: Batch) -> DataFrame:
    """Messages that wait for another delivery: those the stream's last batch left, or those that
    other streams left if this is its first one."""
    if batch.number:
        before = Batch(batch.number - 1, batch.stream)
        left = [before] if batches.complete(spark, before.under(out.retry)) else []
    else:
        left = [b for b in _last_retries(spark, out) if b.stream != batch.stream]
    rows = _read_retries(spark, out, left)
    return rows.withColumn("delivery_count", F.col("delivery_count") + 1)


def _last_retries(spark: SparkSession, out: IngestTables) -> list[Batch]:
    last = {s: batches.newest(spark, out.retry, s) for s in batches.streams(spark, out.retry)}
    return [Batch(n, s) for s, n in last.items() if n is not None]


def _read_retries(spark: SparkSession, out: IngestTables, which: list[Batch]) -> DataFrame:
    rows = batches.empty(spark, RETRY)
    for batch in which:
        rows = rows.unionByName(batches.read_batch(spark, out.retry, RETRY, batch).select(
            *RETRY.names))
    return rows


def _arrival_order(rows: DataFrame) -> Column:
    """Broker time, partition and offset where messages bring them, else the message id."""
    known = [F.col(c) for c in ("arrival_ts", "topic_partition", "topic_offset")
             if c in rows.columns]
    return F.struct(*known, reliability.message_order("message_id").alias("id"))


def write_messages(messages: DataFrame, out: IngestTables, batch: Batch | int,
                   uuid_ids: bool = True) -> None:
    """Write one batch of messages; repeating a batch replaces its own output only.

    Bad payloads are the same on every attempt, so they are dead-lettered at once
    (`max_deliveries=1`) unless the messages bring a delivery count of their own. Then a bad
    message below the limit goes to the retry table and comes again with the next batch.
    """
    spark = messages.sparkSession
    batch = as_batch(batch)
    counted = "delivery_count" in messages.columns
    if not counted:
        messages = messages.withColumn("delivery_count", F.lit(1))
    messages = messages.withColumn("message_id", F.col("message_id").cast("string"))
    arrived = "arrival_ts" in messages.columns
    if counted:
        again = waiting(spark, out, batch)
        if not arrived:
            again = again.drop("arrival_ts")
        # The broker may send a waiting message again; its highest count decides.
        messages = dedup.first_by(
            messages.unionByName(again, allowMissingColumns=True), ["message_id"],
            [F.col("delivery_count").desc()])
    decoded = contract.decode_envelope(messages)
    routed = reliability.route_messages(
        contract.classify_for_write(decoded, uuid_ids),
        config.MAX_DELIVERIES if counted else 1,
    )
    stamped = contract.stamp_server_ts(routed, F.col("arrival_ts") if arrived else None)
    # Read several times below. Also pins the write time for this attempt.
    staged = stamped.drop("_kinds", "_raw").withColumn("_order", _arrival_order(stamped))
    # The counts come from the two writes themselves; nothing is read again for them.
    arrived_rows, inserted_rows = Observation(), Observation()
    tables.write_batch(staged.observe(arrived_rows, *_fates()), out.staging, batch)
    stamped = tables.read_batch(spark, out.staging, staged.schema, batch)

    if not keys.exists(spark, out.keys):
        keys.start(spark, out.keys, tables.read_stored_events(spark, out.events, batch), "event_id")
    keys.compact(spark, out.keys, batch)
    good = stamped.filter("route = 'write'")
    stored = keys.known(spark, out.keys, good, "event_id", batch)
    tables.write_events(tables.append_events(good, stored, order="_order"), out.events, batch,
                        inserted_rows)

    # What was written is read back rather than computed again.
    written = tables.read_batch(spark, out.events, tables.BATCHED_EVENTS, batch)
    keys.add(out.keys, written, "event_id", batch)
    tables.write_batch(users.dau_sketches(written), out.sketches, batch)
    tables.write_batch(reliability.to_dead_letter(stamped), out.dead_letters, batch)
    pending = stamped.filter("route = 'pending'")
    if counted:
        missing = [f for f in RETRY.fields if f.name not in pending.columns]
        tables.write_batch(pending.withColumns(
            {f.name: F.lit(None).cast(f.dataType) for f in missing}).select(
            *[F.col(f.name).cast(f.dataType) for f in RETRY.fields]), out.retry, batch)
        _forget_retries(spark, out, batch)
    tables.write_batch(_counts(spark, arrived_rows.get, inserted_rows.get), out.counts, batch)
    tables.drop_batch(spark, out.staging, batch)


def _fates() -> list[Column]:
    """What becomes of the routed messages of a batch; sums to the messages in."""
    def routed(place: str) -> Column:
        return F.count_if(F.col("route") == place)
    return [routed("write").alias("processed"), routed("dlq").alias("dead_lettered"),
            routed("pending").alias("pending"),
            F.count_if(F.col("delivery_count") > 1).alias("reclaimed")]


def _counts(spark: SparkSession, arrived: dict, inserted: dict) -> DataFrame:
    """One row per batch. A write that Spark found to be empty observes nothing."""
    processed, new = arrived.get("processed", 0), inserted.get("rows", 0)
    row = (processed, new, processed - new, arrived.get("reclaimed", 0),
           arrived.get("dead_lettered", 0), arrived.get("pending", 0))
    return spark.range(1, numPartitions=1).select(
        *[F.lit(n).cast(f.dataType).alias(f.name) for n, f in zip(row, COUNTS.fields)])


def _forget_retries(spark: SparkSession, out: IngestTables, batch: Batch) -> None:
    """Delete what no batch will read again: this batch may be repeated, the ones before not."""
    for stream in batches.streams(spark, out.retry):
        if stream != batch.stream and batch.number > 0:
            delete_folder(spark, f"{out.retry}/stream={stream}")
    for name in batches.children(spark, f"{out.retry}/stream={batch.stream}"):
        if name.startswith("batch_id=") and int(name.split("=")[1]) < batch.number - 1:
            delete_folder(spark, f"{out.retry}/stream={batch.stream}/{name}")


def run_ingest(messages: DataFrame, out: IngestTables, checkpoint: str,
               uuid_ids: bool = True, once: bool = False,
               every: str = "5 seconds") -> StreamingQuery:
    """Start the writer on a stream of `(message_id, data)`.

    `once` works off what is there and stops. With the checkpoint and the batch-addressed
    tables a restart neither loses nor doubles rows; a new checkpoint is a new stream, which adds
    to what other streams wrote and knows their events.
    """
    ids: list[str] = []

    def write(rows: DataFrame, number: int) -> None:
        if not ids:  # the checkpoint holds the id that Spark gave the stream
            ids.append(rows.sparkSession.read.text(f"{checkpoint}/metadata").select(
                F.get_json_object("value", "$.id")).first()[0])
        write_messages(rows, out, Batch(number, ids[0]), uuid_ids)

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return writer.trigger(**trigger).start()


def still_waiting(spark: SparkSession, out: IngestTables) -> DataFrame:
    """The messages that wait for another delivery."""
    return _read_retries(spark, out, _last_retries(spark, out))


def stored_events(spark: SparkSession, out: IngestTables) -> DataFrame:
    return tables.read_stored_events(spark, out.events)


def dead_letters(spark: SparkSession, out: IngestTables) -> DataFrame:
    return tables.read_batches(spark, out.dead_letters, DEAD_LETTERS)


def sketches(spark: SparkSession, out: IngestTables) -> DataFrame:
    return tables.read_batches(spark, out.sketches, SKETCHES)


def write_counts(spark: SparkSession, out: IngestTables) -> DataFrame:
    return tables.read_batches(spark, out.counts, COUNTS)
