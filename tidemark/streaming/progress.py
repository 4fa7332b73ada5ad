"""The progress of running streams as a table: rows, durations, state, lag.

A listener writes one small file per finished batch, named after the stream and the batch, so a batch
that is run again replaces its row. Dashboards and alerts read the folder like any other table.
"""

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.sources.batches import children

_PROGRESS = """
id string, name string, batchId long, timestamp string, numInputRows long, batchDuration long,
processedRowsPerSecond double, eventTime map<string,string>,
stateOperators array<struct<numRowsTotal:long,numRowsDroppedByWatermark:long>>,
sources array<struct<description:string,metrics:map<string,string>>>"""

#: What sources call the distance to their newest data: topics in records, folders in files.
_BEHIND = ("maxOffsetsBehindLatest", "numFilesOutstanding")


class ProgressTable(StreamingQueryListener):
    """Writes every batch's progress to `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        self._end_of(event.runId)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        jvm = self.spark._jvm
        file = jvm.org.apache.hadoop.fs.Path(
            f"{self.path}/stream={progress.id}/{progress.batchId}.json")
        out = file.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(file, True)
        out.write(bytearray(progress.json.encode()))
        out.close()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end_of(event.runId).set()

    def _end_of(self, run) -> threading.Event:
        return self.ended.setdefault(str(run), threading.Event())

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until the last batch of a query that has ended is in the table; events come with a delay."""
        self._end_of(query.runId).wait(seconds)


@contextmanager
def recorded(spark: SparkSession, path: str) -> Iterator[ProgressTable]:
    """Record the progress of the queries that run meanwhile."""
    table = ProgressTable(spark, path)
    spark.streams.addListener(table)
    try:
        yield table
    finally:
        spark.streams.removeListener(table)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """A row per batch: stream, name, batch_id, at, input_rows, duration_ms, rows_per_second, watermark,
    state_rows, late_rows (dropped as later than the watermark) and behind (records or files that the
    sources had not handed out yet; null where a source does not tell)."""
    if not any(n.startswith("stream=") for n in children(spark, path)):
        raw = spark.createDataFrame([], "value string")
    else:
        raw = spark.read.option("wholetext", True).text(f"{path}/stream=*")
    p = raw.select(F.from_json("value", _PROGRESS).alias("p")).select("p.*")

    def total(column: str, field: str):
        return F.aggregate(F.coalesce(F.col(column), F.array()), F.lit(0).cast("bigint"),
                           lambda n, s: n + F.coalesce(s[field], F.lit(0)))

    behind = F.array_max(F.transform("sources", lambda s: F.coalesce(
        *[s["metrics"][m].cast("bigint") for m in _BEHIND])))
    return p.select(
        F.col("id").alias("stream"), "name", F.col("batchId").alias("batch_id"),
        F.col("timestamp").cast("timestamp").alias("at"), F.col("numInputRows").alias("input_rows"),
        F.col("batchDuration").alias("duration_ms"),
        F.col("processedRowsPerSecond").alias("rows_per_second"),
        F.col("eventTime")["watermark"].cast("timestamp").alias("watermark"),
        total("stateOperators", "numRowsTotal").alias("state_rows"),
        total("stateOperators", "numRowsDroppedByWatermark").alias("late_rows"),
        behind.alias("behind"))
