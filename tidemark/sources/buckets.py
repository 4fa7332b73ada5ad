"""Tables that are kept by key: bucketed files, so that a join on the key moves the other side only.

A table is cut into `parts` by a hash of its key, a folder each, and every part is bucketed and sorted by
the key. A change rewrites the parts it touches and no others; a join or an aggregate by key reads the
buckets where they lie. The catalog needs to know the table, and `open_table` tells it from the folder.
"""

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialized
from tidemark.sources.batches import children


@dataclass(frozen=True)
class KeyTable:
    """Name in the catalog, folder, key column and layout; the layout of a folder never changes."""

    name: str
    path: str
    key: str
    parts: int = 64
    buckets: int = 64

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")


def open_table(spark: SparkSession, table: KeyTable, schema: T.StructType) -> DataFrame:
    """The table, made known to the catalog if it is not yet; empty if its folder is."""
    if not spark.catalog.tableExists(table.name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"""CREATE TABLE {table.name} ({columns}, part int) USING parquet
            PARTITIONED BY (part) CLUSTERED BY (`{table.key}`) SORTED BY (`{table.key}`)
            INTO {table.buckets} BUCKETS LOCATION '{table.path}'""")
        if children(spark, table.path):
            spark.catalog.recoverPartitions(table.name)
    return spark.table(table.name)


@contextmanager
def _only_parts_written(spark: SparkSession) -> Iterator[None]:
    """Let an overwrite replace the parts it has rows for; `insertInto` takes no option for that."""
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def merge(spark: SparkSession, table: KeyTable, rows: DataFrame, schema: T.StructType,
          better: dict[str, Column]) -> None:
    """Bring the table up to date with `rows`, one per key: a new key is added, of a known one each
    other column becomes `better[column]`, an expression over `old.column` and `new.column`.

    The touched parts are written aside first, as files must not be replaced while they are read.
    Repeating a merge with expressions like `least` changes nothing.
    """
    stored = open_table(spark, table, schema)
    with materialized(rows.select(*schema.names).withColumn("part", table.part())) as fresh:
        # At most one number per part of the layout.
        touched = [r["part"] for r in fresh.select("part").distinct().collect()]
        if not touched:
            return
        with materialized(merged(stored, fresh, touched, table, schema, better)) as result, \
                _only_parts_written(spark):
            result.repartition(table.buckets, table.key).write.mode("overwrite").insertInto(
                table.name)
    spark.catalog.refreshTable(table.name)


def merged(stored: DataFrame, fresh: DataFrame, touched: list[int], table: KeyTable,
           schema: T.StructType, better: dict[str, Column]) -> DataFrame:
    """The new content of the touched parts. The stored side is read in its buckets and not moved."""
    old = stored.filter(F.col("part").isin(touched)).alias("old")
    new = fresh.alias("new")
    key = table.key

    def either(c: str) -> Column:
        return F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}"))

    values = [F.when(F.col(f"old.{key}").isNotNull() & F.col(f"new.{key}").isNotNull(),
                     better[c]).otherwise(either(c)).alias(c) for c in schema.names if c != key]
    columns = {c: v for c, v in zip([c for c in schema.names if c != key], values)}
    return old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer").select(
        *[either(key).alias(key) if c == key else columns[c] for c in schema.names],
        either("part").alias("part"))
