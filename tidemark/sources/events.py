"""Readers for the event table, message streams and load-run statistics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas


def read_events(spark: SparkSession, path: str, schema: T.StructType = schemas.EVENTS,
                ts_col: str = "server_ts") -> DataFrame:
    """The event table with its fixed schema; zone-less times become UTC instants.

    `event_date` is the partition column of tables written by this package and is derived for
    files that lack it.
    """
    df = spark.read.schema(schema).parquet(path)
    df = df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    if "event_date" in df.columns:
        return df
    return df.withColumn("event_date", F.to_date(ts_col))


def read_event_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100,
                      schema: T.StructType = schemas.MESSAGES, file_format: str = "json",
                      **options) -> DataFrame:
    """New files of a landing folder as a stream, in bounded batches."""
    return (
        spark.readStream.schema(schema).format(file_format)
        .options(maxFilesPerTrigger=max_files_per_trigger, **options).load(path)
    )


def read_kafka_messages(spark: SparkSession, servers: str, topic: str,
                        max_per_trigger: int = 1_000_000, **options) -> DataFrame:
    """A topic in the form of `topic_messages`; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .options(**{"kafka.bootstrap.servers": servers, "subscribe": topic,
                    "startingOffsets": "earliest", "maxOffsetsPerTrigger": max_per_trigger,
                    **options}).load()
    )
    return topic_messages(raw)


def topic_messages(raw: DataFrame) -> DataFrame:
    """Topic records as messages: `message_id`, `data` and what orders them.

    Offsets of different partitions say nothing about time, so arrival is ordered by the broker's
    time, then by partition and offset. The id is unique over partitions.
    """
    return raw.select(
        F.concat_ws("-", F.col("partition"), F.col("offset")).alias("message_id"),
        F.col("value").cast("string").alias("data"),
        F.col("timestamp").alias("arrival_ts"),
        F.col("partition").cast("int").alias("topic_partition"),
        F.col("offset").cast("bigint").alias("topic_offset"),
    )


def read_load_stats(spark: SparkSession, path: str) -> DataFrame:
    """A load-run statistics file, in file order by `row_no`."""
    return (
        spark.read.schema(schemas.LOAD_STATS).csv(path, header=True)
        .withColumn("row_no", F.monotonically_increasing_id())
    )
