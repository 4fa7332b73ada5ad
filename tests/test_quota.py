"""Quotas against a plain model that serves one request after the other."""

import random
from collections import defaultdict, deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators import quota


def model(requests, limit, window):
    """requests: (key, ms, id) in order -> {id: (allowed, count, reset)}"""
    kept, out = defaultdict(deque), {}
    for key, now, rid in sorted(requests, key=lambda r: (r[1], r[2])):
        log = kept[key]
        while log and log[0] <= now - window:
            log.popleft()
        if len(log) >= limit:
            wait = max(0, log[0] + window - now) if log else window
            out[rid] = (False, len(log), -(-wait // 1000))
        else:
            log.append(now)
            out[rid] = (True, len(log), -(-window // 1000))
    return out


def engine(spark, requests, limit, window, **options):
    df = spark.createDataFrame(requests, "k string, t bigint, id bigint")
    rows = quota.sliding_quota(df, "k", "t", limit, window, order=["id"], **options).collect()
    assert len(rows) == len(requests)
    return {r["id"]: (r["allowed"], r["count"], r["reset_s"]) for r in rows}


def burst(seed, n, span, keys):
    rng = random.Random(seed)
    return [(rng.choice(keys), rng.randrange(span), i) for i in range(n)]


@pytest.mark.parametrize("limit, window, span", [
    (3, 1_000, 20_000), (1, 500, 10_000), (10, 5_000, 200_000), (40, 1_000, 3_000),
    (5, 60_000, 2_000_000), (1_000, 1_000, 20_000),
])
def test_equals_model(spark, limit, window, span):
    requests = burst(limit, 1_500, span, ["a", "a", "a", "b"])
    assert engine(spark, requests, limit, window) == model(requests, limit, window)


def test_long_run_in_many_pieces(spark):
    """One key is over its limit all the time; every piece depends on the one before."""
    requests = burst(7, 3_000, 40_000, ["hot"]) + [("cold", t, 9_000 + t) for t in range(0, 50)]
    got = engine(spark, requests, 4, 1_000, points_per_piece=150)
    assert got == model(requests, 4, 1_000)


@pytest.mark.parametrize("other", [[], [("b", 5 * i, 1_000 + i) for i in range(700)]])
def test_more_points_in_a_window_than_in_a_piece(spark, other):
    """A window of 90 points, one of 40, pieces of 20; with and without a run that has more pieces."""
    requests = [("a", 10 * i, i) for i in range(90)] + [
        ("a", 1_000 + 20 * i, 100 + i) for i in range(40)] + other
    got = engine(spark, requests, 2, 1_000, points_per_piece=20)
    assert got == model(requests, 2, 1_000)
    assert min(count for _, count, _ in got.values()) >= 0


@pytest.mark.parametrize("seed, points_per_piece, keys", [
    (1, 1, "a"), (2, 3, "ab"), (3, 17, "abc"), (4, 64, "aab"), (5, 400, "abc")])
def test_pieces_of_any_size(spark, seed, points_per_piece, keys):
    spans = random.Random(seed)
    requests = burst(seed, 250, 2_500 if points_per_piece > 3 else 120, list(keys))
    limit = spans.randrange(1, 8)
    window = spans.choice([7, 40, 500])
    if points_per_piece == 1:
        requests = requests[:60]
    assert engine(spark, requests, limit, window, points_per_piece=points_per_piece) == model(
        requests, limit, window)


def test_same_millisecond_and_edges(spark):
    requests = [("a", 1_000, i) for i in range(5)] + [("a", 61_000, 10), ("a", 60_999, 9)]
    got = engine(spark, requests, 3, 60_000)
    assert got == model(requests, 3, 60_000)
    assert got[10][0] and not got[9][0] and got[4] == (False, 3, 60)


def test_crowded_milliseconds(spark):
    requests = burst(11, 1_200, 60, ["a", "a", "b"])
    got = engine(spark, requests, 4, 20)
    assert got == model(requests, 4, 20)


def test_requests_without_a_key_are_not_limited(spark):
    df = spark.createDataFrame([(None, 5, i) for i in range(5)] + [("a", None, 9)],
                               "k string, t bigint, id bigint")
    rows = quota.sliding_quota(df, "k", "t", 1, 1_000, order=["id"]).collect()
    assert [(r["allowed"], r["count"]) for r in rows] == [(True, None)] * 6


def test_limit_zero_denies_all(spark):
    assert engine(spark, [("a", 5, 1), ("a", 6, 2)], 0, 1_000) == {
        1: (False, 0, 1), 2: (False, 0, 1)}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 6_000)), min_size=1,
                     max_size=60),
       limit=st.integers(1, 6))
def test_random_logs(spark, data, limit):
    requests = [(k, t, i) for i, (k, t) in enumerate(data)]
    assert engine(spark, requests, limit, 1_000, points_per_piece=5) == model(
        requests, limit, 1_000)


def test_rolling_count(spark):
    requests = burst(3, 800, 30_000, ["a", "b"])
    df = spark.createDataFrame(requests, "k string, t bigint, id bigint")
    for r in quota.rolling_count(df, "k", "t", 1_000).collect():
        assert r["rolling"] == sum(k == r["k"] and r["t"] - 1_000 < t <= r["t"]
                                   for k, t, _ in requests)


def test_scopes_equal_model(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(8_000), f"10.0.0.{rng.randrange(3)}",
             rng.choice([None, "u1", "u2", "u3"]), rng.random() < 0.6) for i in range(900)]
    limits, window = {"ip": 30, "user": 14, "events": 6}, 1_000
    want, kept = {}, defaultdict(deque)
    for i, now, ip, user, write in sorted(rows, key=lambda r: (r[1], r[0])):
        asked = [("ip", ip)] + ([("user", user)] if user else []) + (
            [("events", user or ip)] if write else [])
        left = {"ip": None, "user": None, "events": None}
        denied = None
        for scope, owner in asked:
            log = kept[scope, owner]
            while log and log[0] <= now - window:
                log.popleft()
            if len(log) >= limits[scope]:
                denied = scope
            else:
                log.append(now)
            left[scope] = max(0, limits[scope] - len(log))
            if denied:
                break
        want[i] = (denied, left["ip"], left["user"], left["events"])
    df = spark.createDataFrame(
        rows, "n bigint, t bigint, ip string, user_id string, event_write boolean")
    got = {r["n"]: (r["denied_scope"], r["ip_remaining"], r["user_remaining"],
                    r["events_remaining"])
           for r in quota.quota_scopes(df, "t", ["n"], limits, window).collect()}
    assert got == want
    assert {w[0] for w in want.values()} == {None, "ip", "user", "events"}


def test_intermediate_tables_can_be_cleared(spark):
    from tidemark.session import clear_intermediate, materialize, shared_dir
    from tidemark.sources.batches import children

    assert materialize(spark.range(3)).count() == 3
    assert children(spark, f"{shared_dir(spark)}/tables")
    clear_intermediate(spark)
    assert children(spark, f"{shared_dir(spark)}/tables") == []
