"""Registered queries: streams. Each works off the whole table and stops; the result is what the
stream's table then holds, which a batch query can state."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.catalog import micros, query, text
from tidemark.plans.catalog_ingest import DUCK_CLAIMS, scratch
from tidemark.plans.catalog_telemetry import DUCK_QUOTA, DUCK_SCOPES
from tidemark.plans.testdata import ACCESS_COLUMNS, STD_COLUMNS, Tables
from tidemark.schemas import MESSAGES, RAW_EVENTS
from tidemark.sources import tables as store
from tidemark.sources.events import read_event_stream
from tidemark.streaming import ingest, live, progress, stateful


PARTS, FILES = 4, 4


def in_files(df: DataFrame, part, path: str, file_format: str = "parquet") -> str:
    """Write the rows once, in `FILES` files for each of `PARTS` parts, the first part oldest, so that
    a stream that takes `FILES` files a batch gets one part after another."""
    df.withColumn("part", part).repartition(FILES).write.partitionBy("part").format(
        file_format).save(path)
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    start = files.getFileStatus(root).getModificationTime()
    for i in range(PARTS):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={i}")
        if files.exists(folder):
            for status in files.listStatus(folder):
                files.setTimes(status.getPath(), start + 1_000 * i, -1)
    return f"{path}/part=*"


def raw_stream(t: Tables, part=None) -> DataFrame:
    """The event table in time order, in several batches, so that state is carried over."""
    week = F.least(F.lit(PARTS - 1), F.floor((F.dayofmonth("ts") - 1) / 8).cast("int"))
    path = in_files(t.events, week if part is None else part, f"{scratch(t)}/files")
    return read_event_stream(t.spark, path, FILES, RAW_EVENTS, "parquet")


def numbered_stream(t: Tables) -> DataFrame:
    """The event table in the order of its ids, in several batches."""
    last = t.events.agg(F.max("event_id")).first()[0] or 0
    part = F.least(F.lit(PARTS - 1), F.floor(F.col("event_id") * PARTS / (last + 1)).cast("int"))
    return raw_stream(t, part)


def event_stream(t: Tables) -> DataFrame:
    """The event contract's shape as a stream; event time needs a zoned timestamp."""
    return raw_stream(t).selectExpr(*STD_COLUMNS).withColumn(
        "server_ts", F.col("server_ts").cast("timestamp"))


def landed(stream: DataFrame, path: str) -> None:
    """Append a stream to a folder and wait for its end."""
    (stream.writeStream.format("parquet").option("path", path)
     .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
     .start().awaitTermination())


def board(t: Tables, result: DataFrame, keys: list[str],
          day_col: str | None = None) -> DataFrame:
    path = scratch(t)
    live.run_board(result, f"{path}/board", keys, f"{path}/checkpoint", once=True,
                   day_col=day_col).awaitTermination()
    read = store.read_by_day if day_col else store.read_snapshot
    return read(t.spark, f"{path}/board", result.schema)


@query("stream_events", "SELECT event_id, user_id, event_type FROM events")
def stream_events(t: Tables):
    path = scratch(t)
    rows = raw_stream(t).select("event_id", "user_id", "event_type")
    landed(rows, path)
    return t.spark.read.schema(rows.schema).parquet(path)


@query("stream_dau", """
SELECT CAST(CAST(server_ts AS DATE) AS VARCHAR) AS metric_date, count(DISTINCT user_id) AS dau
FROM std GROUP BY 1""", ("std",))
def stream_dau(t: Tables):
    return board(t, live.stream_dau(event_stream(t)), ["metric_date"]).select(
        text("metric_date"), "dau")


@query("stream_dau_sketch", """
SELECT CAST(CAST(server_ts AS DATE) AS VARCHAR) AS metric_date, true AS within_5_percent
FROM std GROUP BY 1""", ("std",))
def stream_dau_sketch(t: Tables):
    from tidemark.operators.users import users_per_day
    shown = board(t, live.stream_dau(event_stream(t), exact=False), ["metric_date"])
    exact = users_per_day(t.std).withColumnRenamed("dau", "exact")
    near = F.abs(F.col("dau") / F.col("exact") - 1) < 0.05
    return shown.join(exact, "metric_date").select(
        text("metric_date"), near.alias("within_5_percent"))


@query("stream_epm", """
SELECT epoch_us(time_bucket(INTERVAL 10 SECOND, ts) - to_seconds(10 * g)) AS window_us,
       CAST(count(*) AS DOUBLE) AS events_per_minute
FROM events, (SELECT unnest(generate_series(0, 5)) AS g) GROUP BY 1""")
def stream_epm(t: Tables):
    return board(t, live.stream_epm(event_stream(t)), ["window_start"], "window_date").select(
        micros("window_start", "window_us"), "events_per_minute")


@query("stream_funnel", """
SELECT CAST(CAST(server_ts AS DATE) AS VARCHAR) AS metric_date, event_type AS step,
       count(DISTINCT user_id) AS users FROM std
WHERE event_type <> 'error' AND user_id IS NOT NULL GROUP BY 1, 2""", ("std",))
def stream_funnel(t: Tables):
    return board(t, live.stream_funnel(event_stream(t)), ["metric_date", "step"]).select(
        text("metric_date"), "step", "users")


@query("dedup_ttl_stream", "SELECT event_id, event_type FROM std", ("std",))
def dedup_ttl_stream(t: Tables):
    """The event files arrive twice; the second copy is within the replay window."""
    path = scratch(t)
    t.std.withColumn("server_ts", F.col("server_ts").cast("timestamp")).write.parquet(
        f"{path}/in/copy=1")
    t.std.withColumn("server_ts", F.col("server_ts").cast("timestamp")
                     + F.make_dt_interval(hours=F.lit(1))).write.parquet(f"{path}/in/copy=2")
    schema = T.StructType([f for f in t.std.schema.fields if f.name != "server_ts"]
                          + [T.StructField("server_ts", T.TimestampType())])
    stream = read_event_stream(t.spark, f"{path}/in/copy=*", 1000, schema, "parquet")
    rows = live.dedup_stream(stream).select("event_id", "event_type")
    landed(rows, f"{path}/out")
    return t.spark.read.schema(rows.schema).parquet(f"{path}/out")


@query("stream_sliding_quota", DUCK_QUOTA, recursive=True)
def stream_sliding_quota(t: Tables):
    """The log of `sliding_quota` in four batches; three keys hold all requests."""
    requests = numbered_stream(t).select(
        (F.col("user_id") % 3).alias("k"), (F.col("event_id") * 500).alias("t"), "event_id")
    path = scratch(t)
    ruled = stateful.stream_quota(requests, "k", "t", 30, order=["event_id"]).select(
        "k", "t", "allowed", "count", "reset_s")
    landed(ruled, path)
    return t.spark.read.schema(ruled.schema).parquet(path)


@query("stream_quota_scopes", DUCK_SCOPES + "SELECT * FROM ruled", ("access_log",), recursive=True)
def stream_quota_scopes(t: Tables):
    log = numbered_stream(t).selectExpr(*ACCESS_COLUMNS).withColumn("t", F.col("n") * 50)
    path = scratch(t)
    ruled = stateful.stream_quota_scopes(log, "t", ["n"], {"ip": 30, "user": 12, "events": 5}).select(
        "n", "denied_scope", "ip_remaining", "user_remaining", "events_remaining")
    landed(ruled, path)
    return t.spark.read.schema(ruled.schema).parquet(path)


@query("stream_claims", DUCK_CLAIMS, ("arrivals",))
def stream_claims(t: Tables):
    """Arrivals in four batches by their time; claims end a day after they were made."""
    arrivals = t.arrivals.select("event_id", "n", F.col("arrival_ts").cast("timestamp").alias(
        "arrival_ts"))
    week = F.least(F.lit(PARTS - 1), F.floor(
        F.datediff("arrival_ts", F.lit("2024-01-01").cast("date")) / 8).cast("int"))
    path = scratch(t)
    files = in_files(arrivals, F.greatest(F.lit(0), week), f"{path}/files")
    stream = read_event_stream(t.spark, files, FILES, arrivals.schema, "parquet")
    told = stateful.stream_claims(stream, order=["n"]).select(
        "event_id", micros("arrival_ts", "arrival_us"), "deduplicated", "mode", "status")
    landed(told, f"{path}/out")
    return t.spark.read.schema(told.schema).parquet(f"{path}/out")


_DUCK_FINAL = """
, final AS (SELECT *, CASE WHEN verdict = 'ok' THEN 'write' ELSE 'dlq' END AS final_route
            FROM classified)
"""


def sent_twice(t: Tables) -> DataFrame:
    sent = t.messages.select(F.col("message_id").cast("string").alias("message_id"), "data")
    return sent.unionByName(sent.withColumn("message_id", F.concat("message_id", F.lit("-1"))))


def ran(t: Tables) -> ingest.IngestTables:
    """The writer over all messages, landed as files, each of them sent twice."""
    path = scratch(t)
    sent_twice(t).write.json(f"{path}/landing")
    out = ingest.IngestTables(f"{path}/tables")
    stream = read_event_stream(t.spark, f"{path}/landing", 4)
    with progress.recorded(t.spark, f"{path}/progress") as table:
        writer = ingest.run_ingest(stream, out, f"{path}/checkpoint", once=True)
        writer.awaitTermination()
        table.wait(writer)
    return out


@query("ingest_stream_restart", _DUCK_FINAL + """
SELECT eid AS event_id, CAST(2 AS BIGINT) AS streams FROM final WHERE final_route = 'write'""",
       ("classified",))
def ingest_stream_restart(t: Tables):
    """Two checkpoints write into the same tables: the second one starts its batches at 0 again and
    gets every second message that the first one had, besides new ones."""
    path = scratch(t)
    out = ingest.IngestTables(f"{path}/tables")
    number = F.split_part("message_id", F.lit("-"), F.lit(1)).cast("bigint")
    first = (number % 3 == 0) | (number % 2 == 0)
    for name, rows in (("first", sent_twice(t).filter(first)),
                       ("second", sent_twice(t).filter(number % 2 == 0).unionByName(
                           sent_twice(t).filter(~first)))):
        rows.write.json(f"{path}/{name}")
        stream = read_event_stream(t.spark, f"{path}/{name}", 4)
        ingest.run_ingest(stream, out, f"{path}/checkpoint-{name}", once=True).awaitTermination()
    rows = ingest.stored_events(t.spark, out)
    streams = rows.select("stream").distinct().agg(F.count("*")).scalar()
    return rows.select("event_id", streams.alias("streams"))


@query("ingest_stream_retry", """
, fate AS (
  SELECT *, CASE WHEN verdict = 'ok' THEN 'event'
                 WHEN delivery_count + 3 - message_id % 4 >= 5 THEN 'dead letter'
                 ELSE 'waiting' END AS place,
         least(5, delivery_count + 3 - message_id % 4) AS at_last FROM classified)
SELECT place, CASE WHEN place = 'event' THEN NULL ELSE greatest(delivery_count, at_last) END
           AS delivery_count, count(*) AS n
FROM fate GROUP BY 1, 2""", ("classified",))
def ingest_stream_retry(t: Tables):
    """Messages with delivery counts in four batches: a bad one comes again with every later batch
    until its fifth delivery. Each message is in one place at the end."""
    path = scratch(t)
    sent = t.messages.select(F.col("message_id").cast("string").alias("message_id"), "data",
                             F.col("delivery_count").cast("int").alias("delivery_count"))
    landing = in_files(sent, F.col("message_id").cast("bigint") % PARTS, f"{path}/landing", "json")
    schema = T.StructType([*MESSAGES.fields, T.StructField("delivery_count", T.IntegerType())])
    out = ingest.IngestTables(f"{path}/tables")
    ingest.run_ingest(read_event_stream(t.spark, landing, FILES, schema), out, f"{path}/checkpoint",
                      once=True).awaitTermination()
    count = F.col("delivery_count").cast("bigint")
    places = (
        ingest.stored_events(t.spark, out).select(F.lit("event").alias("place"),
                                                  F.lit(None).cast("bigint").alias("delivery_count"))
        .unionByName(ingest.dead_letters(t.spark, out).select(
            F.lit("dead letter").alias("place"), count.alias("delivery_count")))
        .unionByName(ingest.still_waiting(t.spark, out).select(
            F.lit("waiting").alias("place"), count.alias("delivery_count"))))
    return places.groupBy("place", "delivery_count").agg(F.count("*").alias("n"))


@query("ingest_stream", _DUCK_FINAL + """
SELECT eid AS event_id, session_id, event_type,
       CAST(json_extract(properties, '$.k') AS BIGINT) AS k
FROM final WHERE final_route = 'write'""", ("classified",))
def ingest_stream(t: Tables):
    rows = ingest.stored_events(t.spark, ran(t))
    return rows.select("event_id", "session_id", "event_type",
                       F.get_json_object("properties", "$.k").cast("bigint").alias("k"))


@query("ingest_stream_counts", _DUCK_FINAL + """
SELECT CAST(2 * count(*) FILTER (WHERE final_route = 'write') AS BIGINT) AS processed,
       count(*) FILTER (WHERE final_route = 'write') AS inserted,
       count(*) FILTER (WHERE final_route = 'write') AS conflicts,
       CAST(2 * count(*) FILTER (WHERE final_route = 'dlq') AS BIGINT) AS dead_lettered
FROM final""", ("classified",))
def ingest_stream_counts(t: Tables):
    counts = ingest.write_counts(t.spark, ran(t))
    return counts.agg(*[F.sum(c).alias(c)
                        for c in ("processed", "inserted", "conflicts", "dead_lettered")])


@query("ingest_stream_dead_letters", _DUCK_FINAL + """
SELECT verdict AS reason, CAST(2 * count(*) AS BIGINT) AS n FROM final
WHERE final_route = 'dlq' GROUP BY 1""", ("classified",))
def ingest_stream_dead_letters(t: Tables):
    letters = ingest.dead_letters(t.spark, ran(t))
    return letters.groupBy("reason").agg(F.count("*").alias("n"))


@query("ingest_stream_progress", """
SELECT CAST(2 * count(*) AS BIGINT) AS input_rows, true AS counts_agree, true AS nothing_left
FROM messages""", ("messages",))
def ingest_stream_progress(t: Tables):
    """What the running writer reported, against the counts it stored: every row that came in is
    written, waiting or dead, and nothing was left in the source at the end."""
    out = ran(t)
    seen = progress.read_progress(t.spark, f"{out.root.removesuffix('/tables')}/progress")
    fates = ingest.write_counts(t.spark, out).agg(
        F.sum(F.col("processed") + F.col("dead_lettered") + F.col("pending"))).scalar()
    return seen.agg(
        F.sum("input_rows").alias("input_rows"), (F.sum("input_rows") == fates).alias("counts_agree"),
        F.coalesce(F.max_by("behind", "batch_id") == 0, F.lit(True)).alias("nothing_left"))
