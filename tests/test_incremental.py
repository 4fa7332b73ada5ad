"""Late events in stored metrics, several dimension sets, bounded statement totals, promoted
properties, progress of streams."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import activity, telemetry, users
from tidemark.plans import snapshots
from tidemark.sources import tables
from tidemark.sources.batches import Batch
from tidemark.streaming import live, progress

START = datetime(2024, 1, 1, 6)


def day_events(spark, name, spec):
    """(user, day) rows."""
    return spark.createDataFrame(
        [(f"{name}-{i}", u, START + timedelta(days=d)) for i, (u, d) in enumerate(spec)],
        "event_id string, user_id string, server_ts timestamp")


def test_a_late_batch_changes_exactly_its_days(spark, tmp_path):
    events, path = f"{tmp_path}/events", f"{tmp_path}/snapshots"

    def add(spec, batch):
        tables.write_events(day_events(spark, f"{batch}", spec), events, batch)

    def refresh(at):
        done = snapshots.refresh_daily_users(
            tables.read_stored_events(spark, events), path, f"2024-02-0{at} 00:00:00")
        return {r["metric_date"].day: r["dau"] for r in done.collect()}

    add([("a", 0), ("b", 0), ("a", 1), ("c", 2)], Batch(0, "x"))
    assert refresh(1) == {1: 2, 2: 1, 3: 1}
    assert refresh(2) == {}
    # A late event of the first day and a new day; then another stream, numbered from 0 again.
    add([("z", 0), ("a", 3)], Batch(1, "x"))
    assert refresh(3) == {1: 3, 4: 1}
    add([("q", 2)], Batch(0, "y"))
    add([(None, 1)], Batch(2, "x"))
    assert refresh(4) == {2: 1, 3: 2}
    rows = {r["metric_date"]: (r["dau"], r["computed_at"].day)
            for r in snapshots.refreshed_daily_users(spark, path).collect()}
    assert rows == {date(2024, 1, 1): (3, 3), date(2024, 1, 2): (1, 4), date(2024, 1, 3): (2, 4),
                    date(2024, 1, 4): (1, 3)}


def test_dimension_sets_equal_single_ones(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(40)]), START + timedelta(days=rng.randrange(3)),
             rng.choice(["web", "app", None]), rng.choice(["de", "fr"]), rng.randrange(3))
            for _ in range(600)]
    log = spark.createDataFrame(
        rows, "user_id int, server_ts timestamp, client string, land string, plan int")
    sets = [["client"], ["land", "client"], ["plan"], ["client", "plan", "land"]]
    got = users.daily_metric_by_dim_sets(log, [*sets, [], ["client", "land"]], computed_at=START)
    found = sorted(tuple(r) for r in got.collect())
    want = [tuple(r) for s in sets
            for r in users.daily_metric_by_dim(log, s, computed_at=START).collect()]
    plain = users.as_daily_metric(users.users_per_day(log), "dau", "dau", START)
    assert found == sorted(want + [tuple(r) for r in plain.collect()])
    # One scan, repeated per set only after the users were reduced.
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Expand") == plan.count("Scan") == 1
    assert users.daily_metric_by_dim_sets(log, [[]], computed_at=START).count() == 3


@pytest.mark.parametrize("seed", range(4))
def test_bounded_statements_equal_all_totals(spark, seed):
    rng = random.Random(seed)
    n_texts = [5, 60, 400, 400][seed]
    rows = [(f"select {rng.randrange(n_texts)}",
             rng.choice([None, 0.0, -5.0, 2.5, 2.5, 7.25]) if seed < 3 else rng.expovariate(1),
             rng.randrange(9)) for _ in range(1_500)]
    log = spark.createDataFrame(rows, "query string, duration_ms double, rows long")
    want = [tuple(r) for r in telemetry.top_statements(log).collect()]
    for buckets in (3, 64, 1 << 20):
        got = telemetry.top_statements_bounded(log, buckets=buckets)
        assert [tuple(r) for r in got.collect()] == want
    assert telemetry.top_statements_bounded(log.limit(0)).collect() == []


def test_promoted_properties(spark, tmp_path):
    values = [{"k": 1, "a": {"b": "x y"}}, {"k": "1"}, {"k": 2.5, "ok": True}, {"ok": False, "k": None},
              {"a": {"b": 3}}, {}]
    rows = [(i, json.dumps(values[i % len(values)])) for i in range(60)] + [
        (100, "{bad"), (101, None)]
    log = spark.createDataFrame(rows, "n int, properties string")
    paths = {"$.k": "bigint", "$.a.b": "string", "$.ok": "boolean"}
    activity.promote_properties(log, paths).write.options(
        **activity.bloom_filters(paths)).parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for path, value in (("$.k", 1), ("$.a.b", "x y"), ("$.ok", True), ("$.ok", False), ("$.k", 2.5),
                        ("$.a.b", "3"), ("$.k", 99), ("$.none", "x")):
        got = activity.has_property(stored, path, value)
        assert sorted(r["n"] for r in got.collect()) == sorted(
            r["n"] for r in activity.has_property(log, path, value).collect())
    plan = activity.has_property(stored, "$.a.b", "x y").select(
        "n")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(property_string_2e_a_2e_b,x y)" in plan and "parse_json" not in plan
    names = {activity.promoted_column(p, "string") for p in ("$.a.b", "$.a_b", "$.a_2e_b", "$.ab")}
    assert len(names) == 4


def test_progress_of_a_stream(spark, tmp_path):
    """Rows, state and rows dropped as late, batch by batch; a second run goes on in the same table."""
    def run(spec, name):
        day_events(spark, name, spec).write.mode("append").parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema(
            "event_id string, user_id string, server_ts timestamp").parquet(f"{tmp_path}/in/*")
        with progress.recorded(spark, f"{tmp_path}/progress") as table:
            query = live.dedup_stream(stream).writeStream.format("parquet").option(
                "path", f"{tmp_path}/out").option(
                "checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
            table.wait(query)

    assert progress.read_progress(spark, f"{tmp_path}/progress").collect() == []
    run([("a", 0), ("b", 5), ("c", 5)], "first")
    run([("late", 1), ("d", 6)], "second")
    rows = progress.read_progress(spark, f"{tmp_path}/progress").orderBy("batch_id").collect()
    assert sum(r["input_rows"] for r in rows) == 5
    assert sum(r["late_rows"] for r in rows) >= 1 and max(r["state_rows"] for r in rows) >= 2
    assert len({r["stream"] for r in rows}) == 1
    assert [r["batch_id"] for r in rows] == sorted({r["batch_id"] for r in rows})
    assert max(r["watermark"] for r in rows if r["watermark"]) >= START + timedelta(days=4)
