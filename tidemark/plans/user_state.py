"""User state that is kept up to date batch by batch and answers without events: numbers of users and
bitmaps of the active ones per day and event type.

    <path>/numbers/batch=<n>     user, number
    <path>/bitmaps/metric_date=  event_type, block, bitmap
    first-seen table             user, first_ts, in buckets by user

A batch that is repeated writes the same numbers into its own folder and sets the same bits.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import retention, user_sets
from tidemark.sources import buckets, tables
from tidemark.sources.batches import children, complete

BITMAPS = T.StructType([
    T.StructField("event_type", T.StringType()), T.StructField("block", T.LongType()),
    T.StructField("bitmap", T.BinaryType()), T.StructField("metric_date", T.DateType())])
_KEYS = ["metric_date", "event_type", "block"]


def _numbers_schema(events: DataFrame, user_col: str) -> T.StructType:
    return T.StructType([T.StructField(user_col, events.schema[user_col].dataType),
                         T.StructField("number", T.LongType())])


def read_numbers(spark: SparkSession, path: str, schema: T.StructType,
                 before: int | None = None) -> DataFrame:
    """The numbers of all batches, or of those before one."""
    folders = [f"{path}/numbers/{name}" for name in children(spark, f"{path}/numbers")
               if name.startswith("batch=") and complete(spark, f"{path}/numbers/{name}")
               and (before is None or int(name.split("=")[1]) < before)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame(
        [], schema)


def read_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_by_day(spark, f"{path}/bitmaps", BITMAPS)


def add_batch(events: DataFrame, path: str, batch: int, user_col: str = "user_id",
              ts_col: str = "server_ts", type_col: str = "event_type") -> None:
    """Bring the state up to date with a batch of events; only days that the batch has are rewritten,
    late ones included. Batches are added one after another, by one writer."""
    spark = events.sparkSession
    schema = _numbers_schema(events, user_col)
    fresh = user_sets.number_new(events, read_numbers(spark, path, schema, batch), user_col)
    fresh.select(*schema.names).write.mode("overwrite").parquet(f"{path}/numbers/batch={batch}")
    new = user_sets.user_bitmaps(events, read_numbers(spark, path, schema), user_col, ts_col,
                                 type_col)
    days = new.select("metric_date").distinct()
    old = read_bitmaps(spark, path).join(days, "metric_date", "left_semi")
    merged = user_sets.merge_bitmaps(
        new.select(*BITMAPS.names).unionByName(old.select(*BITMAPS.names)),
        ["metric_date", "event_type"])
    tables.upsert_by_day(spark, f"{path}/bitmaps", merged.select(
        *[F.col(f.name).cast(f.dataType) for f in BITMAPS.fields]), _KEYS, "metric_date")


def _first_seen_schema(events: DataFrame, user_col: str) -> T.StructType:
    return T.StructType([T.StructField(user_col, events.schema[user_col].dataType),
                         T.StructField("first_ts", T.TimestampType())])


def first_seen_table(spark: SparkSession, table: buckets.KeyTable, events: DataFrame) -> DataFrame:
    """The stored first-seen table: user, first_ts. Joins and aggregates by user do not move it."""
    return buckets.open_table(spark, table, _first_seen_schema(events, table.key)).drop("part")


def add_first_seen(events: DataFrame, table: buckets.KeyTable, ts_col: str = "server_ts") -> None:
    """Bring the first-seen table up to date with a batch of events, late ones included. Only the batch
    is shuffled; the parts its users lie in are read in place and rewritten."""
    seen = retention.first_seen(events, table.key, ts_col).withColumn(
        "first_ts", F.col("first_ts").cast("timestamp"))
    buckets.merge(events.sparkSession, table, seen, _first_seen_schema(events, table.key),
                  {"first_ts": F.least("old.first_ts", "new.first_ts")})
