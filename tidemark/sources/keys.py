"""The keys of a table that only grows, so that new rows can be checked without reading the table.

Every batch adds one run of its keys. When a level holds `FAN_OUT` runs they are merged into one run
of the next level, split by hash buckets. A probe reads the key column alone, in the buckets of the
keys it asks for, and lists no more than `FAN_OUT` runs per level, however many batches there were.

Keys of a batch that may be repeated stay in a run of their own until a later batch has begun, so a
repeated batch never meets its own keys.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import delete_folder
from tidemark.sources.batches import Batch, children, complete, empty

BUCKETS = 256
FAN_OUT = 8

_RUN = T.StructType([T.StructField("key", T.StringType()), T.StructField("bucket", T.IntegerType())])


def _bucketed(keys: DataFrame, column: str) -> DataFrame:
    key = F.col(column).cast("string").alias("key")
    return keys.select(key).filter(F.col("key").isNotNull()).distinct().withColumn(
        "bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))


def _runs(spark: SparkSession, path: str) -> dict[int, list[str]]:
    """Complete runs by level."""
    return {
        int(level.split("=")[1]): [
            f"{path}/{level}/{run}" for run in children(spark, f"{path}/{level}")
            if complete(spark, f"{path}/{level}/{run}")]
        for level in children(spark, path) if level.startswith("level=")
    }


def _settled(runs: list[str], batch: Batch) -> list[str]:
    """First-level runs but those of this batch and later ones of its stream."""
    out = []
    for run in runs:
        stream, _, number = run.rsplit("run=", 1)[1].rpartition("-")
        if stream != batch.stream or int(number) < batch.number:
            out.append(run)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_runs(spark, path))


def start(spark: SparkSession, path: str, keys: DataFrame, column: str) -> None:
    """Make the key table of rows that are already there."""
    _bucketed(keys, column).write.partitionBy("bucket").parquet(
        f"{path}/level=1/run={uuid.uuid4().hex}")


def add(path: str, keys: DataFrame, column: str, batch: Batch) -> None:
    """Add a batch's keys; adding the same batch again replaces them."""
    _bucketed(keys, column).write.mode("overwrite").parquet(
        f"{path}/level=0/run={batch.stream}-{batch.number}")


def known(spark: SparkSession, path: str, asked: DataFrame, column: str,
          batch: Batch) -> DataFrame:
    """The asked keys that were added before this batch, in a column named like `column`."""
    wanted = _bucketed(asked, column)
    # At most BUCKETS small numbers.
    buckets = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]
    stored = empty(spark, _RUN)
    for level, runs in _runs(spark, path).items():
        runs = _settled(runs, batch) if level == 0 else runs
        for run in runs:
            stored = stored.unionByName(spark.read.schema(_RUN).option("basePath", run).parquet(run))
    hits = stored.filter(F.col("bucket").isin(buckets)).join(wanted, ["key", "bucket"], "left_semi")
    return hits.select(F.col("key").alias(column)).distinct()


def compact(spark: SparkSession, path: str, batch: Batch) -> None:
    """Merge full levels. Call it before a batch adds its keys."""
    levels = _runs(spark, path)
    level = 0
    while level in levels:
        runs = _settled(levels[level], batch) if level == 0 else levels[level]
        if len(runs) < FAN_OUT:
            break
        merged = empty(spark, _RUN)
        for run in runs:
            merged = merged.unionByName(
                spark.read.schema(_RUN).option("basePath", run).parquet(run))
        target = f"{path}/level={level + 1}/run={uuid.uuid4().hex}"
        (merged.hint("rebalance", "bucket").sortWithinPartitions("bucket", "key")
         .write.partitionBy("bucket").parquet(target))
        for run in runs:
            delete_folder(spark, run)
        level += 1
        levels.setdefault(level, []).append(target)
