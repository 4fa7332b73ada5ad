"""The first-seen table in buckets: same rows as over all events, and no exchange of the stored side."""

import random
import re
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import retention
from tidemark.plans import user_state
from tidemark.sources import buckets
from tidemark.sources.buckets import KeyTable

START = datetime(2024, 1, 1)


def events(spark, seed, n, users):
    rng = random.Random(seed)
    return spark.createDataFrame(
        [(None if rng.random() < 0.1 else f"u{rng.choice(users)}",
          START + timedelta(minutes=rng.randrange(50_000))) for _ in range(n)],
        "user_id string, server_ts timestamp")


@pytest.fixture
def table(spark, tmp_path):
    found = KeyTable(f"seen_{uuid.uuid4().hex}", f"{tmp_path}/seen", "user_id", parts=16, buckets=4)
    yield found
    spark.sql(f"DROP TABLE IF EXISTS {found.name}")


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_equal_all_events(spark, table):
    batches = [events(spark, i, 300, range(20 * i, 150)) for i in range(3)]
    log = None
    for batch in [*batches, batches[0]]:
        user_state.add_first_seen(batch, table)
        log = batch if log is None else log.unionByName(batch)
        assert rows(user_state.first_seen_table(spark, table, log)) == rows(
            retention.first_seen(log).select("user_id", "first_ts"))


def test_only_touched_parts_are_rewritten(spark, table, tmp_path):
    user_state.add_first_seen(events(spark, 1, 400, range(100)), table)
    before = files(tmp_path)
    user_state.add_first_seen(events(spark, 2, 5, [7]), table)
    after = files(tmp_path)
    changed = {re.search(r"part=(\d+)", f)[1] for f in set(before) ^ set(after)}
    assert len(changed) == 1
    assert all(after[f] == t for f, t in before.items() if f in after)
    log = events(spark, 1, 400, range(100)).unionByName(events(spark, 2, 5, [7]))
    assert rows(user_state.first_seen_table(spark, table, log)) == rows(
        retention.first_seen(log).select("user_id", "first_ts"))


def test_stored_side_is_not_moved(spark, table):
    log = events(spark, 1, 2_000, range(900))
    user_state.add_first_seen(log, table)
    schema = user_state._first_seen_schema(log, "user_id")
    fresh = retention.first_seen(events(spark, 2, 50, range(900))).withColumn("part", table.part())
    plan = buckets.merged(buckets.open_table(spark, table, schema), fresh, list(range(16)), table,
                          schema, {"first_ts": F.least("old.first_ts", "new.first_ts")})
    text = plan._jdf.queryExecution().executedPlan().toString()
    above = text[:text.index("Bucketed: true")].splitlines()
    # From the scan of the table up to the join there is no exchange.
    side = []
    for line in reversed(above):
        if "Join" in line:
            break
        side.append(line)
    assert any("Join" in line for line in above) and not any("Exchange" in line for line in side)
    # Counting by user needs none either.
    counted = user_state.first_seen_table(spark, table, log).groupBy("user_id").count()
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_a_new_session_finds_the_table(spark, table):
    log = events(spark, 3, 200, range(60))
    user_state.add_first_seen(log, table)
    again = KeyTable(f"again_{uuid.uuid4().hex}", table.path, "user_id", 16, 4)
    assert rows(user_state.first_seen_table(spark, again, log)) == rows(
        retention.first_seen(log).select("user_id", "first_ts"))
    spark.sql(f"DROP TABLE {again.name}")


def test_nothing_known(spark, table):
    log = events(spark, 1, 5, [1]).filter("user_id IS NULL")
    user_state.add_first_seen(log, table)
    assert rows(user_state.first_seen_table(spark, table, log)) == []
