"""Shared helpers: intermediate tables in the shared folder and bounded slices of Arrow batches."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import delete_folder, shared_dir

SLICE_BYTES = 4 << 20


class Scratch:
    """Tables that an operator writes to the folder all executors share, and reads back.

    They survive the loss of an executor and hold values fixed that a task run again could draw
    anew. Closing it deletes them, so what is still lazy by then must have been written itself.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        return table

    def drop(self, table: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        delete_folder(self.spark, self.paths.pop(id(table)))

    def close(self) -> None:
        delete_folder(self.spark, self.root)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    tables = Scratch(spark)
    try:
        yield tables
    finally:
        tables.close()


def modest_batches(spark: SparkSession) -> None:
    """Send texts to Python in small Arrow batches. The default of 64 MB is held several times over on
    both sides, outside of the heap; texts are worked through in slices of 4 MB anyway."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))


def free_name(name: str, columns: list[str]) -> str:
    """A name for a helper column that none of the columns has; case makes no difference."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(columns: list[str], names) -> list[str]:
    """The columns but for those that a result's own columns replace."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


def keep(df: DataFrame) -> DataFrame:
    """Write a result whose inputs are about to be deleted; it stays in the shared folder."""
    return Scratch(df.sparkSession).table(df)


def _cut(texts: pa.Array, at: int, size: int) -> int:
    """The row up to which the texts from row `at` on hold about `size` bytes, one row at least."""
    low, high = at + 1, len(texts)
    while low < high:
        middle = (low + high + 1) // 2
        if texts.slice(at, middle - at).nbytes <= size:
            low = middle
        else:
            high = middle - 1
    return low


def pieces(texts: pa.Array, size: int = 1 << 20) -> Iterator[pa.Array]:
    """Texts cut into runs of about `size` bytes at most, or one text."""
    at = 0
    while at < len(texts):
        end = _cut(texts, at, size)
        yield texts.slice(at, end - at)
        at = end


def slices(batches: Iterator[pa.RecordBatch], column: str,
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a text column holds about `size` bytes at most, or one row."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        at = 0
        while at < batch.num_rows:
            end = _cut(batch.column(i), at, size)
            yield batch.slice(at, end - at)
            at = end
