import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contract, reliability

ID = "00000000-0000-4000-8000-00000000000{}"
GOOD = {"event_id": ID.format(1), "user_id": ID.format(2), "session_id": "s1",
        "event_type": "view", "properties": {"page": "/home"},
        "client_ts": "2024-01-01T00:00:00Z"}


def messages(spark, *payloads):
    rows = [(str(i), p if isinstance(p, (str, type(None))) else json.dumps(p), 5)
            for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "message_id string, data string, delivery_count int")


def verdict(spark, payload):
    df = contract.classify_for_write(contract.decode_envelope(messages(spark, payload)))
    return df.select("verdict").first()[0]


@pytest.mark.parametrize("change, want", [
    ({}, "ok"),
    ({"user_id": None}, "ok"), ({"user_id": ""}, "ok"), ({"client_ts": "yesterday"}, "ok"),
    ({"event_type": "unknown"}, "ok"), ({"properties": [1]}, "ok"),
    ({"event_id": ID.format(1).upper()}, "ok"),
    ({"event_id": None}, "invalid_payload"), ({"event_id": 0}, "invalid_payload"),
    ({"event_id": ""}, "invalid_payload"), ({"event_id": []}, "invalid_payload"),
    ({"event_id": 5}, "invalid_event"), ({"event_id": "x"}, "invalid_event"),
    ({"event_id": 12345678901234567890123456789012}, "invalid_event"),
    ({"session_id": ""}, "invalid_event"), ({"session_id": None}, "invalid_event"),
    ({"event_type": ""}, "invalid_event"), ({"event_type": False}, "invalid_event"),
    ({"user_id": "x"}, "exception:ValueError"), ({"user_id": 7}, "exception:AttributeError"),
    ({"client_ts": 5}, "exception:TypeError"), ({"client_ts": 0}, "ok"),
    ({"session_id": 5}, "exception:DBAPIError"),
    ({"session_id": "x" * 65}, "exception:DBAPIError"),
    ({"session_id": "0"}, "ok"),
])
def test_verdict(spark, change, want):
    assert verdict(spark, {**GOOD, **change}) == want


@pytest.mark.parametrize("text", [
    "{bad", "[]", '"x"', "5", "null", '{"event_id": "a"} x', "{}{}", "{},{}", "  ", "{'a': 1}",
])
def test_text_that_is_no_object_is_a_parse_error(spark, text):
    row = contract.decode_envelope(messages(spark, text)).first()
    assert row["_parse_error"] and row["_raw"] == text
    assert verdict(spark, text) == "invalid_payload"


@pytest.mark.parametrize("text", ["", None, "{}"])
def test_empty_payload_is_no_parse_error(spark, text):
    row = contract.decode_envelope(messages(spark, text)).first()
    assert not row["_parse_error"] and row["_raw"] is None and row["event_id"] is None


def test_last_of_repeated_keys_counts(spark):
    row = contract.decode_envelope(messages(spark, '{"session_id":"a","session_id":"b"}')).first()
    assert row["session_id"] == "b"


def test_properties_keep_their_shape(spark):
    df = contract.classify_for_write(contract.decode_envelope(
        messages(spark, {**GOOD, "properties": {"a": {"b": [1, None]}}},
                 {**GOOD, "properties": None}, {**GOOD, "properties": {}})))
    got = [r[0] for r in df.orderBy("message_id").select("properties").collect()]
    assert [json.loads(g) for g in got] == [{"a": {"b": [1, None]}}, {}, {}]


@pytest.mark.parametrize("change, want", [
    ({}, []), ({"session_id": ""}, ["session_id"]), ({"session_id": "x"}, []),
    ({"session_id": "x" * 64}, []), ({"session_id": "x" * 65}, ["session_id"]),
    ({"event_type": "click"}, ["event_type"]), ({"user_id": None}, []),
    ({"user_id": "x"}, ["user_id"]), ({"event_id": None}, ["event_id"]),
    ({"properties": [1]}, ["properties"]), ({"properties": None}, ["properties"]),
    ({"client_ts": "yesterday"}, ["client_ts"]), ({"session_id": 5}, ["session_id"]),
    ({"client_ts": 1700000000}, []), ({"client_ts": 99999999}, []), ({"client_ts": -5}, []),
    ({"client_ts": 12345678.5}, []), ({"client_ts": 17040672000000}, []),
    ({"client_ts": 1704067200000}, []), ({"client_ts": 10 ** 15}, ["client_ts"]),
    ({"client_ts": "1704067200"}, []), ({"client_ts": "20240101"}, []),
])
def test_strict_form(spark, change, want):
    df = contract.validate_event(contract.decode_envelope(messages(spark, {**GOOD, **change})))
    assert df.select("errors").first()[0] == want


def test_strict_form_of_typed_columns(spark):
    df = spark.createDataFrame(
        [(ID.format(1), None, "s", "view", None), ("x", None, "s", "view", "[]")],
        "event_id string, user_id string, session_id string, event_type string,"
        " properties string")
    got = [r[0] for r in contract.validate_event(df).select("errors").collect()]
    assert got == [[], ["event_id", "properties"]]


def test_encode_then_decode(spark):
    df = spark.createDataFrame(
        [(ID.format(1), None, 'quote " and \\', "view", '{"a":[1,2]}')],
        "event_id string, user_id string, session_id string, event_type string,"
        " properties string")
    sent = contract.encode_envelope(df)
    assert json.loads(sent.first()["data"])["user_id"] is None
    back = contract.decode_envelope(sent).first()
    assert back["session_id"] == 'quote " and \\' and json.loads(back["properties"]) == {
        "a": [1, 2]}


@pytest.mark.parametrize("n, reason", [
    (0, "empty_batch"), (1, None), (100, None), (101, "batch_too_large"),
])
def test_batch_bounds(spark, n, reason):
    body = json.dumps({"events": [{**GOOD, "event_id": ID.format(i % 10)} for i in range(n)]})
    rows, rejected = contract.explode_batches(
        spark.createDataFrame([(1, body)], "batch_id int, body string"))
    assert rows.count() == (0 if reason else n)
    assert [r["reason"] for r in rejected.collect()] == ([reason] if reason else [])


@pytest.mark.parametrize("body, reason", [
    ('{"events": [5]}', "invalid_body"), ('{"events": 5}', "invalid_body"), ("{}", "invalid_body"),
    ("{bad", "invalid_body"), ('{"events": [null]}', "invalid_event"),
    ('{"events": [{}]}', "invalid_event"),
])
def test_bad_batch_bodies(spark, body, reason):
    rows, rejected = contract.explode_batches(
        spark.createDataFrame([(1, body)], "batch_id int, body string"))
    assert rows.count() == 0
    assert [r["reason"] for r in rejected.collect()] == [reason]


def test_one_bad_member_rejects_the_batch(spark):
    body = json.dumps({"events": [GOOD, {**GOOD, "event_type": "x"}]})
    rows, rejected = contract.explode_batches(
        spark.createDataFrame([(1, body)], "batch_id int, body string"))
    assert rows.count() == 0 and rejected.first()["reason"] == "invalid_event"


def test_size_limit_counts_bytes(spark):
    df = spark.createDataFrame([("a" * 262_144,), ("a" * 262_145,), ("é" * 131_073,)],
                               "data string")
    kept, rejected = contract.split_oversize(df)
    assert kept.count() == 1 and rejected.count() == 2


def test_dead_letters_wrap_unreadable_text(spark):
    classified = contract.classify_for_write(
        contract.decode_envelope(messages(spark, "{bad", "", {**GOOD, "user_id": "x"})))
    letters = reliability.to_dead_letter(reliability.route_messages(classified))
    got = {r["original_id"]: (r["reason"], json.loads(r["data"])) for r in letters.collect()}
    assert got["0"] == ("invalid_payload", {"_raw": "{bad", "_parse_error": True})
    assert got["1"] == ("invalid_payload", {})
    assert got["2"][0] == "exception:ValueError" and got["2"][1]["user_id"] == "x"


def test_filters_reach_the_scan_below_the_verdict(spark, tmp_path):
    path = str(tmp_path / "m")
    messages(spark, GOOD, {**GOOD, "event_id": "x"}).withColumn(
        "n", F.col("message_id").cast("int")).write.parquet(path)
    rows = contract.classify_for_write(contract.decode_envelope(spark.read.parquet(path)))
    plan = spark._jvm.PythonSQLUtils.explainString(
        rows.filter("n > 0 and verdict = 'ok'")._jdf.queryExecution(), "formatted")
    assert "GreaterThan(n,0)" in plan
    assert rows.filter("verdict = 'ok'").count() == 1


def test_address_hashes_must_fit(spark):
    rows = contract.classify_for_write(contract.decode_envelope(
        messages(spark, {**GOOD, "ip_hash": "a" * 64}, {**GOOD, "ip_hash": "a" * 65})))
    got = [r[0] for r in rows.orderBy("message_id").select("verdict").collect()]
    assert got == ["ok", "exception:DBAPIError"]


def test_messages_are_decoded_once(spark):
    """No inferred filter that parses and classifies every message a second time."""
    rows = spark.range(3).select(F.concat(F.lit('{"event_id":"'), "id", F.lit('"}')).alias("data"))
    classified = contract.classify_for_write(contract.decode_envelope(rows))
    plan = spark._jvm.PythonSQLUtils.explainString(classified._jdf.queryExecution(), "formatted")
    assert "from_json" in plan and "Filter" not in plan
    assert [r["verdict"] for r in classified.collect()] == ["invalid_event"] * 3
