"""Stored state: bitmaps of users, theta and KLL sketches, against counts over the events."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import funnel, retention, sketches, user_sets, users
from tidemark.plans import user_state

START = datetime(2024, 1, 1)


def events(spark, seed, n, n_users, days, user_type="long"):
    rng = random.Random(seed)
    rows = [(None if rng.random() < 0.05 else rng.randrange(n_users),
             START + timedelta(days=rng.randrange(days), seconds=rng.randrange(86_400)),
             rng.choice(["view", "search", "add_to_cart", "order", "other"])) for _ in range(n)]
    return spark.createDataFrame(rows, "user_id long, server_ts timestamp, event_type string") \
        .withColumn("user_id", F.col("user_id").cast(user_type))


def windows(spark, spans):
    return spark.createDataFrame(
        [((START + timedelta(days=a)).date(), (START + timedelta(days=b)).date()) for a, b in spans],
        "window_start date, window_end date")


@pytest.mark.parametrize("user_type", ["long", "string"])
def test_bitmaps_equal_events(spark, tmp_path, user_type):
    """Three batches, the last one late and added twice; then any days from the state alone."""
    batches = [events(spark, i, 700, 300 + 100 * i, days, user_type)
               for i, days in enumerate((10, 20, 5))]
    path = str(tmp_path)
    for i, batch in [*enumerate(batches), (2, batches[2])]:
        user_state.add_batch(batch, path, i)
    log = batches[0].unionByName(batches[1]).unionByName(batches[2])
    known = log.filter("user_id IS NOT NULL").select("user_id").distinct().count()
    numbers = user_state.read_numbers(spark, path, user_state._numbers_schema(log, "user_id"))
    assert sorted(r["number"] for r in numbers.collect()) == list(range(1, known + 1))
    assert numbers.select("user_id").distinct().count() == known

    stored = user_state.read_bitmaps(spark, path)
    spans = windows(spark, [(0, 6), (3, 9), (0, 19), (17, 25), (40, 46)])
    counted = user_sets.users_of_windows(stored, spans)
    for r in counted.collect():
        assert r["users"] == users.in_days(log, r["window_start"], r["window_end"]).agg(
            F.count_distinct("user_id")).first()[0]
    wanted = funnel.funnel_for_windows(log, spans).orderBy("window_start", "window_end")
    got = user_sets.funnel_of_windows(stored, spans).orderBy("window_start", "window_end")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in wanted.collect()]
    assert all(path in f for f in stored.inputFiles()) and "bitmaps" in stored.inputFiles()[0]


def test_more_users_than_one_bitmap_holds(spark, tmp_path):
    log = spark.range(90_000).select(
        F.col("id").alias("user_id"), F.lit(START).cast("timestamp").alias("server_ts"),
        F.when(F.col("id") % 2 == 0, "view").otherwise("order").alias("event_type"))
    user_state.add_batch(log, str(tmp_path), 0)
    stored = user_state.read_bitmaps(spark, str(tmp_path))
    assert stored.select("block").distinct().count() >= 3
    assert user_sets.count_users(stored, []).first()["users"] == 90_000
    by_type = {r["event_type"]: r["users"] for r in user_sets.count_users(
        stored, ["event_type"]).collect()}
    assert by_type == {"view": 45_000, "order": 45_000}


def test_batch_without_known_users(spark, tmp_path):
    empty = events(spark, 1, 20, 5, 2).filter("user_id IS NULL")
    user_state.add_batch(empty, str(tmp_path), 0)
    user_state.add_batch(events(spark, 1, 20, 5, 2), str(tmp_path), 1)
    stored = user_state.read_bitmaps(spark, str(tmp_path))
    assert user_sets.count_users(stored, []).first()["users"] == 5


def test_retention_of_many_users_within_five_percent(spark):
    """More users per day than a sketch keeps, so that sizes and overlaps are estimates."""
    people = spark.range(200_000).withColumn("first", (F.col("id") % 2).cast("int"))
    ages = F.when(F.col("id") % 3 == 0, F.array(F.lit(0), F.lit(1))).when(
        F.col("id") % 5 == 0, F.array(F.lit(0), F.lit(7))).otherwise(F.array(F.lit(0)))
    log = people.withColumn("age", F.explode(ages)).select(
        F.col("id").alias("user_id"), (F.lit(START).cast("timestamp") + F.make_dt_interval(
            days=F.col("first") + F.col("age"))).alias("server_ts"))
    got = {r["cohort_date"]: r for r in sketches.retention_estimate(
        sketches.cohort_sketches(retention.first_seen(log)),
        sketches.activity_sketches(log)).collect()}
    rows = retention.retention_series(log).collect()
    assert len(rows) == len(got) == 2
    for r in rows:
        for c in ("cohort_size", "d1_retained", "d7_retained"):
            assert abs(got[r["cohort_date"]][c] / r[c] - 1) < 0.05
        assert abs(got[r["cohort_date"]]["d1_rate"] / r["d1_rate"] - 1) < 0.08


def test_small_cohorts_are_exact_and_merge(spark):
    log = events(spark, 4, 3_000, 150, 20)
    half = F.pmod(F.hash("user_id", "server_ts"), F.lit(2)) == 0
    active = sketches.merge_theta(sketches.activity_sketches(log.filter(half)).unionByName(
        sketches.activity_sketches(log.filter(~half))), ["metric_date"])
    got = sketches.retention_estimate(
        sketches.cohort_sketches(retention.first_seen(log)), active).orderBy("cohort_date")
    want = retention.retention_series(log).select(got.columns).orderBy("cohort_date")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def requests(spark, n):
    rng = random.Random(3)
    return spark.createDataFrame(
        [(START + timedelta(seconds=rng.randrange(7_200)), rng.choice(["GET", "POST"]),
          f"/users/{rng.randrange(50)}", rng.choice([200, 200, 500]),
          None if rng.random() < 0.02 else rng.lognormvariate(-3, 1.5)) for _ in range(n)],
        "ts timestamp, method string, path string, status int, duration_s double")


def test_latency_of_any_range(spark):
    log = requests(spark, 20_000)
    stored = sketches.latency_sketches(log)
    for start, end in ((None, None), (START + timedelta(minutes=30), START + timedelta(minutes=90))):
        rows = log.filter(F.col("duration_s").isNotNull())
        if start:
            rows = rows.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
        report = sketches.latency_report(stored, start, end)
        assert report.count() == 2
        for r in report.collect():
            ms = sorted(x["duration_s"] * 1000 for x in rows.filter(
                F.col("method") == r["method"]).collect())
            assert r["path"] == "/users/{id}" and r["requests"] == len(ms)
            for name, q in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)):
                assert abs(sum(x <= r[name] for x in ms) / len(ms) - q) < 0.02
    total = sketches.latency_report(stored, by=[], quantiles=[0.999])
    assert total.columns == ["requests", "failures", "p99_9_ms"]
    assert total.first()["requests"] == log.filter("duration_s IS NOT NULL").count()


def test_no_requests_in_range(spark):
    stored = sketches.latency_sketches(requests(spark, 50))
    later = START + timedelta(days=3)
    assert sketches.latency_report(stored, later, later + timedelta(days=1)).collect() == []
    assert sketches.latency_report(stored.limit(0)).collect() == []
