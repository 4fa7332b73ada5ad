"""Live quotas and claims: batch after batch, against the models that serve one row after another."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_quota import burst, model
from tidemark.operators.dedup import claim_times
from tidemark.streaming import stateful


def drive(spark, folder, build, batches, schema):
    """Feed the batches one by one to a query over one checkpoint, a run per batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(
            f"{folder}/in/batch={i}")
        out = build(spark.readStream.schema(schema).parquet(f"{folder}/in/batch=*"))
        out.writeStream.format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/checkpoint").trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


def served(requests, limit, window):
    """The plain model, of requests in order of arrival; an older one is judged at the last time."""
    last, rising = {}, []
    for i, (key, t, rid) in enumerate(requests):
        last[key] = max(t, last.get(key, t))
        rising.append((key, last[key], (i, rid)))
    return {rid: answer for (_, rid), answer in model(rising, limit, window).items()}


def test_decide_equals_model():
    rng = random.Random(2)
    for _ in range(200):
        limit, window = rng.randrange(0, 5), rng.randrange(1, 30)
        requests = [("k", t, i) for i, t in enumerate(sorted(rng.randrange(80) for _ in range(60)))]
        want = model(requests, limit, window)
        kept_t, kept_n, got = [], [], 0
        for cut in (requests[:20], requests[20:45], requests[45:]):
            points, counts = np.unique([t for _, t, _ in cut], return_counts=True)
            allowed, _, _ = stateful.decide(points, counts, kept_t, kept_n, limit, window)
            got += int(allowed.sum())
            assert len(kept_t) <= max(limit, 1) + 1
        assert got == sum(a for a, _, _ in want.values()) or any(
            requests[c - 1][1] == requests[c][1] for c in (20, 45))


def test_quota_over_restarts(spark, tmp_path):
    """Three runs of the query over one checkpoint: the state is carried from run to run. One key
    holds nine tenths of the requests."""
    requests = sorted(burst(5, 900, 9_000, ["hot"] * 9 + ["b"]), key=lambda r: (r[1], r[2]))
    requests = [(k, t, i) for i, (k, t, _) in enumerate(requests)]
    extra = [(None, 5, 2_000), ("b", None, 2_001)]
    cuts = [requests[:300] + extra, requests[300:600], requests[600:]]
    rows = drive(spark, tmp_path, lambda s: stateful.stream_quota(s, "k", "t", 4, 1_000, ["id"]),
                 cuts, "k string, t long, id long")
    got = {r["id"]: (r["allowed"], r["count"], r["reset_s"]) for r in rows}
    assert len(rows) == 902 and got.pop(2_000) == got.pop(2_001) == (True, None, None)
    assert got == served(requests, 4, 1_000)


def test_late_requests_and_forgotten_keys(spark, tmp_path):
    """A request from before the key's last one counts at that one's time. With a short watermark the
    state of a key that went quiet is cleared by its timer, and it starts anew."""
    first = [("a", 10_000 + i, i) for i in range(4)]
    second = [("a", 9_990, 10), ("a", 10_500, 11), ("b", 30_000, 12)]
    third = [("b", 30_500, 20), ("a", 40_000, 21)]
    rows = drive(spark, tmp_path,
                 lambda s: stateful.stream_quota(s, "k", "t", 3, 1_000, ["id"], watermark="2 seconds"),
                 [first, second, third], "k string, t long, id long")
    got = {r["id"]: (r["allowed"], r["count"], r["reset_s"]) for r in rows}
    assert got == served(first + second + third, 3, 1_000)
    assert got[10] == got[11] == (False, 3, 1) and got[21] == (True, 1, 1)


def test_limit_zero(spark, tmp_path):
    rows = drive(spark, tmp_path, lambda s: stateful.stream_quota(s, "k", "t", 0, 1_000, ["id"]),
                 [[("a", 5, 1), ("a", 6, 2)]], "k string, t long, id long")
    assert {(r["allowed"], r["count"], r["reset_s"]) for r in rows} == {(False, 0, 1)}
    with pytest.raises(ValueError):
        stateful.stream_quota(spark.readStream.schema("k string, t long").parquet(f"{tmp_path}/in"),
                              "k", "t", 1)


def claims_model(arrivals, ttl):
    claim, out = {}, {}
    for key, t, n in arrivals:
        fresh = key not in claim or t >= claim[key] + ttl
        if fresh:
            claim[key] = t
        out[n] = not fresh
    return out


def test_claims_end_after_their_own_time(spark, tmp_path):
    """Replays keep coming all the time; a claim ends a day after it was made all the same."""
    rng = random.Random(8)
    hours = sorted(rng.randrange(24 * 9 * 60) for _ in range(500))
    arrivals = [(rng.choice("aaab"), m * 60, n) for n, m in enumerate(hours)]
    arrivals += [("c", 86_400 * d, 1_000 + d) for d in range(9)]
    arrivals.sort(key=lambda r: (r[1], r[2]))
    cuts = [arrivals[i:i + 130] for i in range(0, len(arrivals), 130)]

    def build(stream):
        timed = stream.select("k", F.timestamp_seconds("s").alias("at"), "n")
        return stateful.stream_claims(timed, "k", "at", ["n"])

    rows = drive(spark, tmp_path, build, [c + [(None, 5, -1 - i)] for i, c in enumerate(cuts)],
                 "k string, s long, n long")
    got = {r["n"]: r["deduplicated"] for r in rows}
    assert [got.pop(-1 - i) for i in range(len(cuts))] == [False] * len(cuts)
    assert got == claims_model(arrivals, 86_400)
    assert {r["status"] for r in rows} == {"queued", "deduplicated"}


def test_claim_times():
    times = np.array([0, 5, 9, 10, 10, 19, 20, 35])
    taken, last = claim_times(times, None, 10)
    assert taken.tolist() == [True, False, False, True, False, False, True, True] and last == 35
    taken, last = claim_times(times, 1, 10)
    assert taken.tolist() == [False] * 5 + [True, False, True] and last == 35
    assert claim_times(times[:0], 7, 10)[1] == 7


def test_keys_share_a_call_and_its_state(spark, tmp_path):
    """Thousands of keys in two groups: a call and a timer per group, not per key, and the answers
    of the models all the same. Quiet keys leave a group that lives on."""
    rng = random.Random(9)
    arrivals = sorted((rng.randrange(86_400 * 6), f"k{rng.randrange(1_500)}", n) for n in range(4_000))
    rows = [(k, s, n) for s, k, n in arrivals]
    cuts = [rows[i:i + 1_000] for i in range(0, 4_000, 1_000)]

    def claims(stream):
        timed = stream.select("k", F.timestamp_seconds("s").alias("at"), "n")
        return stateful.stream_claims(timed, "k", "at", ["n"], groups=2)

    told = drive(spark, tmp_path / "claims", claims, cuts, "k string, s long, n long")
    assert {r["n"]: r["deduplicated"] for r in told} == claims_model(rows, 86_400)

    requests = [(k, s, n) for k, s, n in rows]
    ruled = drive(spark, tmp_path / "quota", lambda s: stateful.stream_quota(
        s, ["k", "b"], "s", 2, 50_000, ["n"], watermark="20 seconds", groups=2),
        [[(k, s, n, b"\xff") for k, s, n in c] for c in cuts], "k string, s long, n long, b binary")
    got = {r["n"]: (r["allowed"], r["count"], r["reset_s"]) for r in ruled}
    assert got == served(requests, 2, 50_000)
    for name, fewest in (("claims", 500), ("quota", 100)):
        held = spark.read.format("statestore").option("stateVarName", {
            "claims": "claims", "quota": "kept"}[name]).load(f"{tmp_path}/{name}/checkpoint").collect()
        keys = [stateful.pa.ipc.open_stream(bytes(r["value"]["keys"])).read_all().num_rows
                for r in held]
        assert len(keys) == 2 and fewest <= sum(keys) < 1_500
