"""Session settings the operators rely on."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that can be changed on a running session.
RUNTIME_SETTINGS = {
    # Every day boundary is a UTC day.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JIT leaves methods beyond 8000 bytes interpreted. Such a stage runs faster as single
    # operators, whose code is split into small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A JSON object that repeats a key keeps the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for name, value in RUNTIME_SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    On a cluster it is the one named by ``spark.checkpoint.dir``. Only a local master, where
    driver and executors share one disk, falls back to a temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"


def _write_aside(df: DataFrame) -> str:
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read to the shared folder and read it back.

    Unlike cached blocks it survives the loss of executors, and later filters reach the files.
    The table stays until `clear_intermediate`, as its readers are lazy.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_write_aside(df))


def clear_intermediate(spark: SparkSession) -> None:
    """Delete all intermediate tables in the shared folder. Results that were computed from them and
    are still lazy can no longer be read, so write or collect those first."""
    delete_folder(spark, f"{shared_dir(spark)}/tables")


@contextmanager
def materialized(df: DataFrame) -> Iterator[DataFrame]:
    """The same for a result whose readers have all finished inside the block."""
    path = _write_aside(df)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        delete_folder(df.sparkSession, path)
