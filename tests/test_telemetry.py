import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import telemetry
from tidemark.sources.events import read_load_stats

T0 = datetime(2024, 1, 1)


def log(spark, *rows):
    return spark.createDataFrame(
        [(T0 + timedelta(seconds=s), "GET", path, status, float(d))
         for s, path, status, d in rows],
        "ts timestamp_ntz, method string, path string, status int, duration_s double")


@pytest.mark.parametrize("durations, want", [
    ([0.004], 0.005 * 0.95), ([20.0], 10.0), ([0.02, 0.02], 0.01 + 0.015 * 0.95),
    ([0.001] * 94 + [3.0] * 6, 2.5 + 2.5 * (95 - 94) / 6),
])
def test_histogram_quantile(spark, durations, want):
    df = log(spark, *[(0, "/x", 200, d) for d in durations])
    got = telemetry.histogram_quantile(telemetry.latency_histogram(df)).first()["quantile"]
    assert got == pytest.approx(want)


def test_buckets_are_cumulative_and_inclusive(spark):
    rows = telemetry.latency_histogram(
        log(spark, (0, "/a/1", 200, 0.005), (0, "/a/2", 200, 0.1), (0, "/a/3", 200, 99))).collect()
    counts = {r["le"]: r["le_count"] for r in rows}
    assert counts["0.005"] == 1 and counts["0.1"] == 2 and counts["10.0"] == 2
    assert counts["+Inf"] == 3 and {r["path"] for r in rows} == {"/a/{id}"}


@pytest.mark.parametrize("resolution", [0.001, 0.5, 1000.0])
def test_exact_percentiles(spark, resolution):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), round(rng.expovariate(1), rng.choice([1, 4]))) for _ in range(999)]
    rows += [("c", 2.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    marks = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for r in telemetry.exact_percentiles(df, "v", marks, ["g"], resolution).collect():
        values = [v for g, v in rows if g == r["g"]]
        assert [r[m] for m in marks] == pytest.approx(
            [np.quantile(values, q) for q in marks.values()])


def test_reports(spark):
    df = log(spark, *[(i, f"/u/{i}", 500 if i == 3 else 200, 0.1 * (i + 1)) for i in range(11)])
    one = telemetry.aggregate_report(df).first()
    assert one["requests"] == 11 and one["failures"] == 1 and one["error_rate"] == "9.091%"
    assert one["median_ms"] == pytest.approx(600) and one["rps"] == pytest.approx(1.1)
    each = telemetry.endpoint_report(df).collect()
    assert [r["name"] for r in each] == ["GET /u/{id}"]


HEAD = ("Type,Name,Request Count,Failure Count,Median Response Time,Average Response Time,"
        "Min Response Time,Max Response Time,Average Content Size,Requests/s,Failures/s,"
        "50%,66%,75%,80%,90%,95%,98%,99%,99.9%,99.99%,100%\n")


@pytest.mark.parametrize("names, want", [
    (["/a", "Aggregated", "/b"], 1), (["/a", "/b"], 1), (["total", "Aggregated"], 0),
])
def test_totals_row_of_a_load_run(spark, tmp_path, names, want):
    path = tmp_path / "run_stats.csv"
    path.write_text(HEAD + "".join(
        f"GET,{n},{100 + i},0,,5.5,1,9,10,2.5,0,7,7,7,7,7,95,7,99,7,7,7\n"
        for i, n in enumerate(names)))
    one = telemetry.aggregate_row(read_load_stats(spark, str(path)), "row_no").first()
    assert one["requests"] == 100 + want and one["error_rate"] == "0.000%"
    assert one["median_ms"] == 7 and one["p95_ms"] == 95 and one["p99_ms"] == 99


def test_error_rate_without_requests(spark):
    from pyspark.sql import functions as F
    df = spark.range(1).select(telemetry.error_rate(F.lit(0), F.lit(0)).alias("e"))
    assert df.first()["e"] == "0%"


def test_crowded_slots_are_cut_further(spark, monkeypatch):
    monkeypatch.setattr(telemetry, "_SLOT_ROWS", 20)
    rng = random.Random(5)
    rows = [(g, rng.random() * 1e-4 if rng.random() < 0.9 else 0.5) for g in "ab" for _ in range(900)]
    rows += [("c", 0.25)] * 100
    df = spark.createDataFrame(rows, "g string, v double")
    got = telemetry.exact_percentiles(df, "v", {"p50": 0.5, "p95": 0.95}, ["g"], 1.0).collect()
    for r in got:
        values = [v for g, v in rows if g == r["g"]]
        assert r["p50"] == pytest.approx(np.percentile(values, 50), rel=1e-12)
        assert r["p95"] == pytest.approx(np.percentile(values, 95), rel=1e-12)
    assert len(got) == 3


def test_reports_have_no_task_for_all_groups(spark):
    df = telemetry.endpoint_report(log(spark, (0, "/a", 200, 1.0), (9, "/b", 500, 2.0)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(specifiedwindowframe" not in plan
    assert {(r["name"], r["requests"], r["rps"]) for r in df.collect()} == {
        ("GET /a", 1, 1 / 9), ("GET /b", 1, 1 / 9)}
