from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup
from tidemark.sources import tables

T0 = datetime(2024, 1, 1, 12)


def arrivals(spark, *rows):
    return spark.createDataFrame(
        [(k, T0 + timedelta(hours=h), v) for k, h, v in rows],
        "event_id string, arrival_ts timestamp_ntz, v int")


def test_first_arrival_wins(spark):
    df = arrivals(spark, ("a", 2, 1), ("a", 0, 2), ("b", 1, 3), ("a", 1, 4))
    got = {r["event_id"]: r["v"] for r in dedup.dedup_first(df).collect()}
    assert got == {"a": 2, "b": 3}


def test_dedup_reduces_before_the_shuffle(spark):
    plan = dedup.dedup_first(arrivals(spark, ("a", 0, 1)))._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_null_keys_are_kept_apart_from_stored_ids(spark):
    df = arrivals(spark, (None, 0, 1), ("a", 0, 2), ("b", 0, 3))
    stored = arrivals(spark, ("a", 0, 0), (None, 0, 0))
    got = {r["event_id"] for r in dedup.new_events_only(df, stored).collect()}
    assert got == {None, "b"}


@pytest.mark.parametrize("mode, taken", [("sync", "accepted"), ("async", "queued")])
def test_outcome(spark, mode, taken):
    df = arrivals(spark, ("a", 0, 1), ("a", 1, 2), ("b", 0, 3), ("s", 0, 4))
    out = dedup.ingest_outcome(df, arrivals(spark, ("s", -5, 0)), mode)
    got = {r["v"]: (r["status"], r["deduplicated"], r["mode"]) for r in out.collect()}
    dup = ("deduplicated", True, mode)
    assert got == {1: (taken, False, mode), 2: dup, 3: (taken, False, mode), 4: dup}


def test_outcome_with_a_second_order_column(spark):
    df = arrivals(spark, ("a", 0, 2), ("a", 0, 1), ("a", 0, 3))
    out = dedup.ingest_outcome(df, arrivals(spark).limit(0), "sync", order=["arrival_ts", "v"])
    assert {r["v"]: r["deduplicated"] for r in out.collect()} == {1: False, 2: True, 3: True}


def test_claims_end_after_their_time(spark):
    df = arrivals(spark, ("a", 0, 1), ("a", 23, 2), ("a", 24, 3), ("a", 47, 4), ("a", 49, 5))
    out = dedup.ingest_outcome(df, df.limit(0), "async", claim_ttl_seconds=86_400)
    got = {r["v"]: r["status"] for r in out.collect()}
    assert got == {1: "queued", 2: "deduplicated", 3: "queued", 4: "deduplicated", 5: "queued"}


def test_batch_counts(spark):
    df = arrivals(spark, ("a", 0, 1), ("a", 1, 1), ("b", 0, 2))
    out = dedup.batch_outcome(dedup.ingest_outcome(df, df.limit(0), "async"), "v")
    assert {tuple(r) for r in out.collect()} == {(1, 1, 1), (2, 1, 0)}


def test_expired_keys(spark):
    df = spark.createDataFrame(
        [(h, T0 - timedelta(hours=h)) for h in (47, 48, 49)], "k int, expires_at timestamp_ntz")
    kept, gone = dedup.expire_keys(df, F.lit(T0).cast("timestamp_ntz"))
    assert {r["k"] for r in kept.collect()} == {47, 48} and gone.first()["k"] == 49


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in dedup.upsert(old, new, "k").collect()} == {
        (1, "a"), (2, "c"), (3, "d")}


def test_versioned_update(spark):
    users = spark.createDataFrame(
        [(i, f"n{i}", True, 3, 4) for i in range(1, 8)],
        "id int, full_name string, is_active boolean, role_id int, version bigint")
    roles = spark.createDataFrame([(1, "admin"), (3, "client_app")], "id int, name string")
    changes = spark.createDataFrame(
        [(1, 4, None, "new", None, 1), (1, 4, None, "late", None, 2), (2, 3, None, "x", None, 3),
         (9, 1, None, "x", None, 4), (3, 4, "root", "x", None, 5),
         (4, 4, "analyst", "x", None, 6), (5, 4, "admin", None, False, 7),
         (6, 3, None, "stale", None, 8), (6, 4, None, "fresh", None, 9)],
        "id int, version bigint, role string, full_name string, is_active boolean, arrival int")
    table, outcomes = dedup.versioned_update(users, changes, roles)
    assert {r["arrival"]: r["outcome"] for r in outcomes.collect()} == {
        1: "applied", 2: "version_conflict", 3: "version_conflict", 4: "not_found",
        5: "conflict", 6: "not_found", 7: "applied", 8: "version_conflict", 9: "applied"}
    got = {r["id"]: tuple(r)[1:] for r in table.collect()}
    assert got[1] == ("new", True, 3, 5) and got[2] == ("n2", True, 3, 4)
    assert got[5] == ("n5", False, 1, 5) and got[6] == ("fresh", True, 3, 5)
    assert len(got) == 7 and table.schema == users.schema


def test_snapshot_versions(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    tables.upsert_snapshot(spark, path, rows, "k")
    tables.upsert_snapshot(spark, path, rows.filter("k = 2").withColumn("v", F.lit("c")), "k")
    assert {tuple(r) for r in tables.read_snapshot(spark, path, rows.schema).collect()} == {
        (1, "a"), (2, "c")}
    # a version without its success mark was never published
    (tmp_path / "snap" / "version=3").mkdir()
    assert tables.snapshot_version(spark, path) == 2


def test_rows_without_a_key_are_no_replays(spark):
    df = arrivals(spark, (None, 0, 1), (None, 0, 1), ("a", 1, 2), ("a", 0, 3))
    assert sorted((r["event_id"], r["v"]) for r in dedup.dedup_first(df).collect()
                  if r["event_id"]) == [("a", 3)]
    assert dedup.dedup_first(df).count() == 3
    none = df.limit(0)
    for options in ({"mode": "sync"}, {"mode": "async", "claim_ttl_seconds": 60}):
        got = dedup.ingest_outcome(df.dropDuplicates(), none, **options).collect()
        assert [r["deduplicated"] for r in got if r["event_id"] is None] == [False]


def test_insert_if_absent_inserts_a_key_once(spark):
    known = spark.createDataFrame([("a", "old")], "email string, name string")
    rows = spark.createDataFrame([("b", "y"), ("b", "x"), ("a", "new"), (None, "n"), (None, "n")],
                                 known.schema)
    got = sorted(map(tuple, dedup.insert_if_absent(known, rows, "email").collect()), key=str)
    assert got == [("a", "old"), ("b", "x"), (None, "n"), (None, "n")]


def test_the_newest_of_repeated_updates_wins(spark):
    columns = "k string, value int, computed_at timestamp"
    old = spark.createDataFrame([("a", 1, T0), ("z", 9, T0)], columns)
    updates = spark.createDataFrame(
        [("a", 2, T0 + timedelta(hours=1)), ("a", 3, T0), ("b", 4, T0), ("b", 5, T0)], columns)
    got = sorted((r["k"], r["value"]) for r in dedup.upsert(old, updates, "k").collect())
    assert got == [("a", 2), ("b", 5), ("z", 9)]


def test_claims_of_a_key_replayed_without_end(spark):
    seconds = [*range(0, 400_000, 97), *range(86_395, 86_405), 1_000_000, 1_086_399, 1_086_400]
    rows = [("hot", T0 + timedelta(seconds=s)) for s in sorted(set(seconds))]
    rows += [(f"k{i}", T0 + timedelta(hours=i)) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id string, arrival_ts timestamp_ntz")
    got = dedup.claims(df, "event_id", "arrival_ts", 86_400).collect()
    want, last = set(), None
    for key, at in rows:
        if key != "hot" or last is None or at >= last + timedelta(days=1):
            want.add((key, at))
            last = at if key == "hot" else last
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    plan = dedup.claims(df, "event_id", "arrival_ts", 86_400)._jdf.queryExecution().toString()
    assert "Window" not in plan
