import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import retention, users
from tidemark.sources import keys, tables
from tidemark.sources.batches import Batch
from tidemark.plans import snapshots
from tidemark.plans.summary import metrics_summary
from tidemark.sources.events import read_event_stream, read_events, topic_messages
from tidemark.streaming import ingest, live

EVENT = "00000000-0000-4000-8000-{:012d}"


def message(mid, event, **change):
    body = {"event_id": EVENT.format(event), "user_id": EVENT.format(event % 7),
            "session_id": "s", "event_type": "view", "properties": {"n": event}, **change}
    return {"message_id": str(mid), "data": json.dumps(body)}


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def start(spark, tmp_path, files=1, **options):
    stream = read_event_stream(spark, str(tmp_path / "in"), files)
    out = ingest.IngestTables(str(tmp_path / "out"))
    ingest.run_ingest(stream, out, str(tmp_path / "ck"), once=True, **options).awaitTermination()
    return out


def test_replays_and_restart(spark, tmp_path):
    land(tmp_path / "in", "1.json", [message(i, i) for i in range(20)])
    land(tmp_path / "in", "2.json", [message(100 + i, i) for i in range(10, 30)]
         + [{"message_id": "900", "data": "{bad"}, message(901, 5, user_id="x")])
    out = start(spark, tmp_path)
    assert ingest.stored_events(spark, out).count() == 30
    counts = ingest.write_counts(spark, out).agg(
        F.sum("processed"), F.sum("inserted"), F.sum("conflicts"), F.sum("dead_lettered")).first()
    assert tuple(counts) == (40, 30, 10, 2)
    # nothing new: nothing changes
    start(spark, tmp_path)
    assert ingest.stored_events(spark, out).count() == 30
    # new files: only they are read, and old ids are still known
    land(tmp_path / "in", "3.json", [message(500 + i, i) for i in range(25, 40)])
    start(spark, tmp_path)
    events = ingest.stored_events(spark, out)
    assert events.count() == 40 and events.select("event_id").distinct().count() == 40
    reasons = {r["reason"] for r in ingest.dead_letters(spark, out).collect()}
    assert reasons == {"invalid_payload", "exception:ValueError"}


def test_repeated_batch_replaces_its_own_rows(spark, tmp_path):
    out = ingest.IngestTables(str(tmp_path))
    rows = spark.createDataFrame([(m["message_id"], m["data"]) for m in
                                  [message(i, i % 8) for i in range(12)]],
                                 "message_id string, data string")
    for batch in (0, 0, 1, 1, 0):
        ingest.write_messages(rows, out, batch)
    assert ingest.stored_events(spark, out).count() == 8
    total = ingest.write_counts(spark, out).agg(F.sum("inserted"), F.sum("conflicts")).first()
    assert tuple(total) == (8, 16)


def test_sketches_follow_the_stored_events(spark, tmp_path):
    land(tmp_path / "in", "1.json", [message(i, i) for i in range(50)])
    land(tmp_path / "in", "2.json", [message(i, i) for i in range(40, 90)])
    out = start(spark, tmp_path)
    total = users.dau_estimate(ingest.sketches(spark, out), [])
    assert total.first()["dau_estimate"] == 7


def test_day_folders_are_pruned(spark, tmp_path):
    rows = spark.createDataFrame(event_rows(300), SCHEMA)
    tables.write_events(rows, str(tmp_path / "e"), 0)
    events = read_events(spark, str(tmp_path / "e"))
    assert events.schema["event_date"].dataType.simpleString() == "date"
    counts = users.users_per_day(users.in_days(events, "2024-01-02", "2024-01-03"))
    plan = spark._jvm.PythonSQLUtils.explainString(counts._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(event_date" in plan
    want = users.users_per_day(users.in_days(rows, "2024-01-02", "2024-01-03")).collect()
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in want} and len(want) == 2
    late = users.active_users(events, "2024-01-08 10:00:00")
    plan = spark._jvm.PythonSQLUtils.explainString(late._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert late.first() == users.active_users(rows, "2024-01-08 10:00:00").first()
    series = retention.retention_series(events)
    plan = spark._jvm.PythonSQLUtils.explainString(series._jdf.queryExecution(), "formatted")
    assert "ReadSchema: struct<user_id:string>" in plan
    assert {tuple(r) for r in series.collect()} == {
        tuple(r) for r in retention.retention_series(rows).collect()}


def counted(spark, rows):
    return spark.createDataFrame(rows, "message_id string, data string, delivery_count int")


def test_bad_messages_wait_until_they_are_spent(spark, tmp_path):
    out = ingest.IngestTables(str(tmp_path))
    good = message(9, 1)["data"]
    for _ in range(2):  # repeating a batch changes nothing
        ingest.write_messages(counted(spark, [("1", "{bad", 4), ("2", "{bad", 5), ("9", good, 1),
                                              ("3", "{bad", 1)]), out, 0)
        assert [r["original_id"] for r in ingest.dead_letters(spark, out).collect()] == ["2"]
        assert {(r.message_id, r.delivery_count) for r in ingest.still_waiting(
            spark, out).collect()} == {("1", 4), ("3", 1)}
        assert tables.read_stored_events(spark, out.events).count() == 1
    for _ in range(2):  # the broker sends one of them again, with its own count
        ingest.write_messages(counted(spark, [("3", "{bad", 3)]), out, 1)
        assert {r["original_id"] for r in ingest.dead_letters(spark, out).collect()} == {"1", "2"}
        assert [tuple(r)[:3] for r in ingest.still_waiting(spark, out).collect()] == [
            ("3", "{bad", 3)]
    total = ingest.write_counts(spark, out).agg(
        F.sum("processed"), F.sum("dead_lettered")).first()
    assert tuple(total) == (1, 2)


def test_a_new_checkpoint_adds_to_the_tables(spark, tmp_path):
    land(tmp_path / "in", "1.json", [message(i, i) for i in range(20)])
    out = start(spark, tmp_path)
    land(tmp_path / "in2", "1.json", [message(i, i) for i in range(15, 25)])
    for _ in range(2):
        stream = read_event_stream(spark, str(tmp_path / "in2"), 1)
        ingest.run_ingest(stream, out, str(tmp_path / "ck2"), once=True).awaitTermination()
        events = ingest.stored_events(spark, out)
        assert events.count() == 25 and events.select("event_id").distinct().count() == 25
        assert events.filter("id is null").count() == 0
        assert events.select("id").distinct().count() == 25


def test_waiting_messages_are_taken_over_by_a_new_stream(spark, tmp_path):
    out = ingest.IngestTables(str(tmp_path))
    ingest.write_messages(counted(spark, [("1", "{bad", 3)]), out, Batch(0, "old"))
    for number in (0, 0, 1):
        ingest.write_messages(counted(spark, [("7", message(7, 7)["data"], 1)]), out,
                              Batch(number, "new"))
    assert [r["original_id"] for r in ingest.dead_letters(spark, out).collect()] == ["1"]
    assert ingest.still_waiting(spark, out).count() == 0


def test_the_probe_reads_a_bounded_number_of_key_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keys, "FAN_OUT", 3)
    path, columns = str(tmp_path / "k"), "event_id string"
    keys.start(spark, path, spark.createDataFrame([("old",)], columns), "event_id")
    for n in range(14):
        batch = Batch(n, "s")
        keys.compact(spark, path, batch)
        asked = spark.createDataFrame([("old",), (f"e{n - 1}",), (f"e{n}",), (None,)], columns)
        for _ in range(2):  # a repeated batch does not meet its own keys
            hits = {r[0] for r in keys.known(spark, path, asked, "event_id", batch).collect()}
            assert hits == {"old"} | ({f"e{n - 1}"} if n else set())
            keys.add(path, spark.createDataFrame([(f"e{n}",)], columns), "event_id", batch)
    runs = keys._runs(spark, path)
    assert all(len(r) <= 4 for r in runs.values()) and max(runs) >= 2
    everything = spark.createDataFrame([(f"e{n}",) for n in range(14)], columns)
    assert keys.known(spark, path, everything, "event_id", Batch(99, "s")).count() == 14


def test_the_writer_probes_keys_and_not_events(spark, tmp_path):
    out = ingest.IngestTables(str(tmp_path))
    rows = spark.createDataFrame([("1", message(1, 1)["data"])], "message_id string, data string")
    ingest.write_messages(rows, out, 0)
    hits = keys.known(spark, out.keys, spark.createDataFrame([(EVENT.format(1),)], "event_id string"),
                      "event_id", Batch(1))
    plan = spark._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "formatted")
    assert "event_keys" in plan and "/events" not in plan and hits.count() == 1


def event_rows(n):
    t0 = datetime(2024, 1, 1)
    return [(str(i), None if i % 10 == 0 else f"u{i % 13}",
             ["view", "search", "order"][i % 3], t0 + timedelta(minutes=37 * i))
            for i in range(n)]


SCHEMA = "event_id string, user_id string, event_type string, server_ts timestamp"


@pytest.fixture
def live_events(spark, tmp_path):
    df = spark.createDataFrame(event_rows(300), SCHEMA)
    # two files in time order, so the watermark moves while the stream runs
    cut = F.lit("2024-01-05").cast("timestamp")
    df.filter(F.col("server_ts") < cut).coalesce(1).write.parquet(str(tmp_path / "e" / "p=1"))
    df.filter(F.col("server_ts") >= cut).coalesce(1).write.parquet(str(tmp_path / "e" / "p=2"))
    stream = read_event_stream(spark, str(tmp_path / "e" / "p=*"), 1, df.schema, "parquet")
    return df, stream


def settle(spark, tmp_path, board, keys):
    live.run_board(board, str(tmp_path / "b"), keys, str(tmp_path / "c"),
                   once=True).awaitTermination()
    return tables.read_snapshot(spark, str(tmp_path / "b"), board.schema)


def test_live_users_equal_batch(spark, tmp_path, live_events):
    df, stream = live_events
    got = settle(spark, tmp_path, live.stream_dau(stream), ["metric_date"]).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in users.users_per_day(df).collect()}
    assert len(got) == 8 and isinstance(got[0]["metric_date"], date)


def test_live_funnel_equals_batch(spark, tmp_path, live_events):
    df, stream = live_events
    got = settle(spark, tmp_path, live.stream_funnel(stream, ["view", "order"]),
                 ["metric_date", "step"])
    want = users.known_users(df).filter("event_type IN ('view', 'order')").groupBy(
        F.to_date("server_ts"), "event_type").agg(F.count_distinct("user_id"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_live_rate_counts_every_event_in_six_windows(spark, tmp_path, live_events):
    _, stream = live_events
    got = settle(spark, tmp_path, live.stream_epm(stream), ["window_start"])
    assert got.agg(F.sum("events_per_minute")).first()[0] == 6 * 300


def test_dedup_within_the_claim_time(spark, tmp_path, live_events):
    df, _ = live_events
    again = df.withColumn("server_ts", F.col("server_ts") + F.expr("INTERVAL 1 HOUR"))
    for i, part in enumerate((df, again)):
        part.coalesce(1).write.parquet(str(tmp_path / "d" / f"p={i}"))
    stream = read_event_stream(spark, str(tmp_path / "d" / "p=*"), 100, df.schema, "parquet")
    query = (live.dedup_stream(stream).writeStream.format("parquet")
             .option("path", str(tmp_path / "o")).option("checkpointLocation",
                                                         str(tmp_path / "oc"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 300


def test_topic_messages_arrive_in_the_order_of_the_broker(spark, tmp_path):
    body = [message(i, 1, session_id=s)["data"] for i, s in enumerate(("late", "first", "later"))]
    t0 = datetime(2024, 1, 1)
    raw = spark.createDataFrame(
        [(body[0].encode(), 0, 1, t0 + timedelta(seconds=5)), (body[1].encode(), 1, 900, t0),
         (body[2].encode(), 1, 901, t0 + timedelta(seconds=9))],
        "value binary, partition int, offset long, timestamp timestamp")
    rows = topic_messages(raw)
    assert {r["message_id"] for r in rows.collect()} == {"0-1", "1-900", "1-901"}
    out = ingest.IngestTables(str(tmp_path))
    ingest.write_messages(rows, out, 0)
    one = ingest.stored_events(spark, out).collect()
    assert [(r["session_id"], r["server_ts"]) for r in one] == [("first", t0)]


def plan_of(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture
def month(spark, tmp_path):
    rows = spark.createDataFrame(event_rows(800), SCHEMA)
    tables.write_events(rows, str(tmp_path / "e"), 0)
    return rows, read_events(spark, str(tmp_path / "e"))


def test_the_summary_reads_nine_days(spark, month):
    rows, events = month
    seen = retention.first_seen(rows)
    as_of = "2024-01-20 12:00:00"
    one = metrics_summary(events, as_of, seen=seen)
    assert "PartitionFilters: [isnotnull(event_date" in plan_of(spark, one)
    assert one.first() == metrics_summary(rows, as_of).first()


def test_stored_snapshots_answer_without_events(spark, month, tmp_path):
    rows, events = month
    seen = retention.first_seen(rows)
    days = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2, 30)], "cohort_date date")
    windows = days.selectExpr("cohort_date AS window_start", "date_add(cohort_date, 2) AS window_end")
    reads = {
        "dau": lambda p: snapshots.daily_users(
            events, days.withColumnRenamed("cohort_date", "metric_date"), p, "2024-02-01"),
        "funnel": lambda p: snapshots.funnel_windows(events, windows, p, "2024-02-01",
                                                     ["view", "order"]),
        "retention": lambda p: snapshots.cohort_retention(events, seen, days, p, "2024-02-01"),
    }
    for name, read in reads.items():
        path = str(tmp_path / name)
        first = read(path)
        assert {r["source"] for r in first.collect()} == {"computed"}
        again = read(path)
        assert {r["source"] for r in again.collect()} == {"database"}
        assert str(tmp_path / "e") not in plan_of(spark, again)
        drop = ["source", "computed_at"]
        assert sorted(first.drop(*drop).collect()) == sorted(again.drop(*drop).collect())
    got = {r["cohort_date"]: r for r in reads["retention"](str(tmp_path / "retention")).collect()}
    want = {r["cohort_date"]: r for r in retention.retention_series(rows).collect()}
    one = date(2024, 1, 1)
    assert (got[one]["cohort_size"], got[one]["d7_rate"]) == (
        want[one]["cohort_size"], want[one]["d7_rate"])
    assert got[date(2024, 1, 30)]["cohort_size"] == 0



def test_empty_tables_need_no_python_worker(spark, tmp_path):
    none = tables.read_batches(spark, str(tmp_path / "none"), ingest.RETRY)
    assert "ExistingRDD" not in plan_of(spark, none)
    assert none.schema == ingest.RETRY and none.count() == 0
