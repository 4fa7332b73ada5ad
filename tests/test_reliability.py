from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reliability

NOW = datetime(2024, 1, 1, 12)


def ledger(spark, *rows):
    return spark.createDataFrame(
        [(i, "{}", n, NOW - timedelta(milliseconds=idle)) for i, n, idle in rows],
        "message_id string, data string, delivery_count int, last_delivered timestamp_ntz")


@pytest.mark.parametrize("verdict, count, want", [
    ("ok", 9, ("write", None)), ("invalid_event", 4, ("pending", None)),
    ("invalid_event", 5, ("dlq", "invalid_event")),
    ("exception:ValueError", 6, ("dlq", "exception:ValueError")),
])
def test_routes(spark, verdict, count, want):
    df = spark.createDataFrame([(verdict, count)], "verdict string, delivery_count int")
    row = reliability.route_messages(df).first()
    assert (row["route"], row["reason"]) == want


def test_reclaim_by_idle_time_and_id(spark):
    book = ledger(spark, ("10-0", 1, 60_000), ("9-0", 2, 70_000), ("9-10", 1, 60_001),
                  ("9-9", 1, 60_000), ("1-0", 1, 59_999))
    as_of = F.lit(NOW).cast("timestamp_ntz")
    taken = reliability.reclaim_stale(book, as_of, limit=3)
    assert {r["message_id"]: r["delivery_count"] for r in taken.collect()} == {
        "9-0": 3, "9-9": 2, "9-10": 2}
    after = reliability.redeliver(book, taken)
    assert after.count() == 5 and reliability.reclaim_stale(after, as_of).count() == 1
    assert reliability.ack_messages(after, taken).count() == 2


def test_queue_stats(spark):
    book = ledger(spark, ("1-0", 1, 0), ("2-0", 1, 0), ("10-0", 1, 0))
    one = reliability.queue_stats(book, book.limit(2), book.limit(1), "2-0").first()
    assert one.asDict() == {"stream": "stream:events", "group": "cg:event-writers", "length": 3,
                            "pending": 2, "lag": 1, "dlq_length": 1}
    assert reliability.queue_stats(book, book, book).first()["lag"] is None


def test_retained_days_never_hold_fewer(spark):
    df = spark.createDataFrame(
        [(d, datetime(2024, 1, d, h)) for d in (1, 2, 3) for h in range(10)],
        "d int, server_ts timestamp_ntz")
    for n, days in [(1, {3}), (10, {3}), (11, {2, 3}), (20, {2, 3}), (21, {1, 2, 3}),
                    (99, {1, 2, 3})]:
        kept = reliability.retain_newest(df, n)
        assert {r["d"] for r in kept.collect()} == days
    assert reliability.retain_newest(df, 7, exact=True).count() == 7


def test_exact_retention_with_ties_and_missing_times(spark):
    times = [datetime(2024, 1, d, h, 0, 0, us) for d in (1, 2, 3) for h in (3, 3, 20)
             for us in (0, 0, 7)] + [None, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "n int, server_ts timestamp_ntz")
    order = sorted(((t or datetime(1, 1, 1), str(i)) for i, t in enumerate(times)), reverse=True)
    for n in (1, 2, 5, 9, 10, 14, 27, 28, 50):
        kept = reliability.retain_newest(df, n, exact=True)
        assert kept.columns == df.columns
        assert sorted(str(r["n"]) for r in kept.collect()) == sorted(i for _, i in order[:n])


def test_ids_that_are_no_numbers_have_an_order(spark):
    df = spark.createDataFrame([("b",), ("10",), ("a",), ("9-3",), ("9",)], "message_id string")
    got = [r[0] for r in df.orderBy(reliability.message_order("message_id")).collect()]
    assert got == ["a", "b", "9", "9-3", "10"]
