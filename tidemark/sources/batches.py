"""Tables of one folder per batch: `<path>/stream=<id>/batch_id=<n>/...`.

Batch numbers start again with every new checkpoint, so the stream's own id is part of the address.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import delete_folder

ADDRESS = [T.StructField("stream", T.StringType()), T.StructField("batch_id", T.LongType())]


@dataclass(frozen=True)
class Batch:
    """A batch of a stream. Writers without a stream number their batches themselves."""

    number: int
    stream: str = "none"

    def under(self, path: str) -> str:
        return f"{path}/stream={self.stream}/batch_id={self.number}"


def as_batch(batch: "Batch | int") -> Batch:
    return batch if isinstance(batch, Batch) else Batch(batch)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, as a relation that the optimizer drops. A local list, even an empty one, would go through
    a Python worker in every task."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return spark.range(1).filter(F.lit(False)).select(*none)


def children(spark: SparkSession, path: str) -> list[str]:
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def complete(spark: SparkSession, path: str) -> bool:
    return "_SUCCESS" in children(spark, path)


def read_batches(spark: SparkSession, path: str, schema: T.StructType,
                 before: Batch | int | None = None) -> DataFrame:
    """All batches of a table, or all but a batch and later ones of its stream."""
    if not any(n.startswith("stream=") for n in children(spark, path)):
        return empty(spark, schema)
    df = spark.read.schema(schema).parquet(path)
    if before is None:
        return df
    before = as_batch(before)
    return df.filter((F.col("stream") != before.stream) | (F.col("batch_id") < before.number))


def read_batch(spark: SparkSession, path: str, schema: T.StructType,
               batch: Batch | int) -> DataFrame:
    """One batch, without listing the other ones."""
    return spark.read.schema(schema).option("basePath", path).parquet(as_batch(batch).under(path))


def write_batch(df: DataFrame, path: str, batch: Batch | int, partition_by: Sequence[str] = (),
                **options) -> None:
    """Write one batch's rows; writing the same batch again replaces them."""
    df.write.mode("overwrite").options(**options).partitionBy(*partition_by).parquet(
        as_batch(batch).under(path))


def drop_batch(spark: SparkSession, path: str, batch: Batch | int) -> None:
    delete_folder(spark, as_batch(batch).under(path))


def newest(spark: SparkSession, path: str, stream: str) -> int | None:
    """Number of a stream's newest complete batch."""
    folder = f"{path}/stream={stream}"
    numbers = sorted((int(n.split("=")[1]) for n in children(spark, folder)
                      if n.startswith("batch_id=")), reverse=True)
    return next((n for n in numbers if complete(spark, f"{folder}/batch_id={n}")), None)


def streams(spark: SparkSession, path: str) -> list[str]:
    return [n.split("=", 1)[1] for n in children(spark, path) if n.startswith("stream=")]
