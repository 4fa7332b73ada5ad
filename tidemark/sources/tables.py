"""Tables on plain Parquet folders: batch-addressed event table, versioned snapshot tables.

Events:    `<path>/stream=<id>/batch_id=<n>/event_date=<day>/*.parquet`
Snapshots: `<path>/version=<n>/*.parquet`, the newest complete version is the table.

Both are safe to repeat: a batch replaces its own folder, a snapshot never overwrites the
version it was computed from. One writer per table.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions import scalars as S
from tidemark.operators import dedup
from tidemark.session import delete_folder, materialized
from tidemark.sources.batches import (  # noqa: F401
    ADDRESS, Batch, children, complete, drop_batch, empty, read_batch, read_batches, write_batch,
)

BATCHED_EVENTS = T.StructType([
    *schemas.EVENTS.fields, *ADDRESS, T.StructField("event_date", T.DateType()),
])


def read_stored_events(spark: SparkSession, path: str,
                       before: Batch | int | None = None) -> DataFrame:
    return read_batches(spark, path, BATCHED_EVENTS, before)


def append_events(batch: DataFrame, target: DataFrame, key: str = "event_id",
                  order: str | Sequence[str] = "server_ts") -> DataFrame:
    """The rows of `batch` to insert: first per key, and not stored yet."""
    return dedup.first_new_events(batch, target, key, order)


def write_events(rows: DataFrame, path: str, batch: Batch | int,
                 counted: Observation | None = None) -> None:
    """Add a batch to the event table, one folder per day, rows in time order within files. An event
    without an `id` gets one made of its event id.

    Rows are rebalanced by day: quiet days end in one file, a busy day is split by size. Time
    order keeps row-group ranges narrow for trailing-window reads; the bloom filter, sized by
    the ids of a file, lets a lookup by id skip row groups. `counted` learns the number of `rows`
    from the write itself.
    """
    known = F.col("id").cast("string") if "id" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("id", F.coalesce(known, S.uuid_of(F.col("event_id").cast("string"))))
    full = rows.select(
        *[F.col(f.name).cast(f.dataType) if f.name in rows.columns
          else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.EVENTS.fields],
        F.to_date("server_ts").alias("event_date"),
    )
    sorted_rows = full.hint("rebalance", "event_date").sortWithinPartitions(
        "event_date", "server_ts")
    if counted is not None:
        sorted_rows = sorted_rows.observe(counted, F.count("*").alias("rows"))
    write_batch(
        sorted_rows, path, batch, ["event_date"],
        **{"parquet.bloom.filter.enabled#event_id": "true",
           "parquet.bloom.filter.adaptive.enabled": "true"},
    )


def snapshot_version(spark: SparkSession, path: str) -> int:
    """Number of the newest complete version, 0 if there is none."""
    numbers = sorted((int(n.split("=")[1]) for n in children(spark, path)
                      if n.startswith("version=")), reverse=True)
    return next((n for n in numbers if complete(spark, f"{path}/version={n}")), 0)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    version = snapshot_version(spark, path)
    if version == 0:
        return empty(spark, schema)
    return spark.read.schema(schema).parquet(f"{path}/version={version}")


def upsert_snapshot(spark: SparkSession, path: str, updates: DataFrame,
                    keys: str | Sequence[str]) -> DataFrame:
    """Insert or replace rows by key, publish the result as a new version and return it.

    The version before stays for readers that are still on it, older ones are removed.
    """
    version = snapshot_version(spark, path)
    current = read_snapshot(spark, path, updates.schema)
    dedup.upsert(current, updates, keys).write.mode("overwrite").parquet(
        f"{path}/version={version + 1}")
    for name in children(spark, path):
        if name.startswith("version=") and int(name.split("=")[1]) < version:
            delete_folder(spark, f"{path}/{name}")
    return read_snapshot(spark, path, updates.schema)


def read_by_day(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A snapshot table that is kept in one folder per day."""
    if not children(spark, path):
        return empty(spark, schema)
    return spark.read.schema(schema).parquet(path)


def upsert_by_day(spark: SparkSession, path: str, updates: DataFrame,
                  keys: str | Sequence[str], day_col: str) -> DataFrame:
    """Insert or replace rows by key, rewriting only the days that have updates.

    For snapshot tables too large to be written anew each time. The new content of those days is
    written aside first, since a folder must not be replaced while it is read.
    """
    with materialized(updates) as fresh:
        touched = fresh.select(day_col).distinct()
        current = read_by_day(spark, path, fresh.schema).join(touched, day_col, "left_semi")
        with materialized(dedup.upsert(current, fresh, keys)) as merged:
            merged.hint("rebalance", day_col).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy(day_col).parquet(path)
    return read_by_day(spark, path, updates.schema)
