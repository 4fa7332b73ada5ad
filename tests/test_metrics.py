from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import activity, funnel, retention, users
from tidemark.plans import readthrough
from tidemark.plans.summary import metrics_summary

SCHEMA = "event_id string, user_id string, event_type string, server_ts timestamp"
D = datetime(2024, 1, 10)


def events(spark, *rows):
    return spark.createDataFrame(
        [(str(i), u, kind, ts) for i, (u, kind, ts) in enumerate(rows)], SCHEMA)


def at(day, hour=0, **more):
    return D + timedelta(days=day, hours=hour, **more)


def test_day_edges_and_anonymous_users(spark):
    df = events(spark, ("a", "view", at(0)), ("a", "view", at(0, 5)),
                ("b", "view", at(1) - timedelta(microseconds=1)), ("c", "view", at(1)),
                (None, "view", at(2)))
    assert users.dau(df, "2024-01-10").first()["dau"] == 2
    series = users.dau_series(df, "2024-01-09", "2024-01-13")
    got = {r["metric_date"].day: int(r["value"]) for r in series.collect()}
    assert got == {9: 0, 10: 2, 11: 1, 12: 0, 13: 0}
    assert series.schema["value"].dataType.simpleString() == "decimal(20,4)"
    assert activity.events_total(df).first()[0] == 5


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "e")
    events(spark, ("a", "view", at(0))).write.parquet(path)
    df = spark.read.schema(SCHEMA).parquet(path)
    counts = funnel.funnel_counts(df, "2024-01-10", "2024-01-11")
    plan = spark._jvm.PythonSQLUtils.explainString(counts._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(server_ts" in plan and "In(event_type" in plan
    assert "IsNotNull(user_id)" in plan
    assert "ReadSchema: struct<user_id:string,event_type:string,server_ts:timestamp>" in plan
    assert "Expand" not in plan


def test_sketches_merge(spark):
    df = events(spark, *[(f"u{i % 700}", "view", at(i % 3)) for i in range(2_100)])
    sketches = users.dau_sketches(df)
    halves = users.dau_sketches(df.filter("int(event_id) < 1000")).unionByName(
        users.dau_sketches(df.filter("int(event_id) >= 1000")))
    whole = {r[0]: r[1] for r in users.dau_estimate(sketches).collect()}
    assert whole == {r[0]: r[1] for r in users.dau_estimate(halves).collect()}
    assert abs(users.dau_estimate(sketches, []).first()[0] / 700 - 1) < 0.03
    fresh = users.expire_sketches(sketches, "2024-01-14 00:00:00")
    assert {r["metric_date"].day for r in fresh.collect()} == {12}


def test_funnel_steps_are_independent(spark):
    df = events(spark, ("a", "order", at(0)), ("b", "order", at(0)), ("b", "order", at(1)),
                ("c", "add_to_cart", at(0)), (None, "view", at(0)), ("d", "order", at(2)),
                ("a", "unknown", at(0)))
    rows = funnel.funnel_steps(funnel.funnel_counts(df, "2024-01-10", "2024-01-11")).collect()
    assert [(r["step"], r["count"], r["conversion_from_previous"]) for r in rows] == [
        ("view", 0, None), ("search", 0, None), ("add_to_cart", 1, None), ("order", 2, 2.0)]


def test_funnel_window_of_one_day_and_empty_window(spark):
    df = events(spark, ("a", "view", at(0)), ("b", "view", at(1)))
    assert funnel.funnel_counts(df, "2024-01-10", "2024-01-10").first()["view"] == 1
    assert tuple(funnel.funnel_counts(df, "2024-02-01", "2024-02-02").first()) == (0, 0, 0, 0)


def test_retention(spark):
    df = events(spark, ("a", "view", at(0)), ("a", "view", at(1)), ("b", "view", at(0)),
                ("b", "view", at(7, 23)), ("c", "view", at(0)), ("c", "view", at(8)),
                ("old", "view", at(-3)), ("old", "view", at(0)), ("old", "view", at(1)),
                (None, "view", at(0)))
    want = (date(2024, 1, 10), 3, 1, 1, "0.3333", "0.3333")

    def read(one):
        return (*tuple(one)[:4], str(one["d1_rate"]), str(one["d7_rate"]))

    assert read(retention.retention(df, "2024-01-10").first()) == want
    seen = retention.first_seen(df)
    assert read(retention.retention(df, "2024-01-10", seen=seen).first()) == want
    series = {r["cohort_date"]: r for r in retention.retention_series(df).collect()}
    assert read(series[date(2024, 1, 10)]) == want and len(series) == 2
    empty = retention.retention(df, "2024-01-11").first()
    assert read(empty) == (date(2024, 1, 11), 0, 0, 0, "0.0000", "0.0000")


def test_events_per_minute_includes_its_edge(spark):
    now = at(0, 12)
    df = events(spark, *[("a", "view", now - timedelta(seconds=s)) for s in (0, 59, 60, 61)])
    one = activity.events_per_minute(df, "2024-01-10 12:00:00").first()
    assert one["events_per_minute"] == 3.0 and one["window_seconds"] == 60


def test_has_property(spark):
    df = spark.createDataFrame(
        [('{"a": {"b": 1}}',), ('{"a": {"b": "1"}}',), ('{"a": true}',), ("{bad",), (None,)],
        "properties string")
    assert activity.has_property(df, "$.a.b", 1).count() >= 1
    assert activity.has_property(df, "$.a.b", "x").count() == 0
    assert activity.has_property(df, "$.a", True).count() == 1


def test_summary_equals_its_parts(spark):
    rows = [(None if i % 9 == 0 else f"u{i % 23}", ["view", "search", "order", "x"][i % 4],
             at(-(i % 15), i % 24, minutes=i % 60)) for i in range(600)]
    df = events(spark, *rows)
    now = "2024-01-10 23:30:00"
    one = metrics_summary(df, now).first()
    assert one["dau_today"] == users.dau(df, "2024-01-10").first()["dau"]
    assert one["events_total"] == 600
    assert one["events_last_minute"] == activity.events_per_minute(df, now).first()[0]
    counts = funnel.funnel_counts(df, "2024-01-04", "2024-01-10").first()
    assert [s["count"] for s in one["funnel"]["steps"]] == list(counts)
    assert one["retention"].asDict() == retention.retention(df, "2024-01-02").first().asDict()


def test_summary_of_nothing(spark):
    one = metrics_summary(events(spark).limit(0), "2024-01-10 00:00:00").first()
    assert one["events_total"] == 0 and one["dau_today"] == 0
    assert one["retention"]["cohort_size"] == 0


@pytest.mark.parametrize("age, source", [(29, "cache"), (30, "database"), (31, "database")])
def test_cached_minute_count(spark, age, source):
    now = at(0, 12)
    df = events(spark, ("a", "view", now))
    cache = spark.createDataFrame([(7.0, now - timedelta(seconds=age))],
                                  "events_per_minute double, cached_at timestamp")
    one = readthrough.read_epm(df, cache, "2024-01-10 12:00:00").first()
    assert (one["source"], one["events_per_minute"]) == (
        source, 7.0 if source == "cache" else 1.0)


def test_stored_answers_have_no_age_limit_by_default(spark):
    df = events(spark, ("a", "view", at(0)))
    days = spark.createDataFrame([(date(2024, 1, 10),), (date(2024, 1, 11),)],
                                 "metric_date date")
    stored = users.dau_series(df, "2024-01-10", "2024-01-10", computed_at="2020-01-01").withColumn(
        "value", F.lit(99).cast("decimal(20,4)"))
    split = stored.withColumn("dim_hash", F.lit("other"))
    cache = stored.select("metric_date", F.lit(5).cast("bigint").alias("dau"), "computed_at",
                          F.col("computed_at").alias("cached_at"))
    out = readthrough.read_dau(df, days, cache, stored.unionByName(split), "2024-01-12")
    got = {r["metric_date"].day: (r["dau"], r["source"], r["refilled"]) for r in out.collect()}
    assert got == {10: (99, "database", True), 11: (0, "computed", True)}
