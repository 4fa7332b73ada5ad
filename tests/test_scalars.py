from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S

UUID = "64860119-a957-4bff-917c-2746444017ec"


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("given, want", [
    ("/api/v1/events/64860119-a957-4bff-917c-2746444017ec", "/api/v1/events/{id}"),
    ("/api/v1/admin/users/42", "/api/v1/admin/users/{id}"),
    ("/a/42ab/7", "/a/{id}ab/{id}"),
    ("/api/v1/x", "/api/v1/x"),
    ("/" + "x" * 130, "/" + "x" * 119),
])
def test_normalize_path(spark, given, want):
    assert one(spark, given, S.normalize_path) == want


@pytest.mark.parametrize("given, want", [
    (UUID, UUID), (UUID.upper(), UUID), (UUID.replace("-", ""), UUID),
    ("{" + UUID + "}", UUID), ("urn:uuid:" + UUID, UUID),
    ("not-a-uuid", None), ("", None), (None, None), (UUID + "0", None),
    (UUID.replace("6", "g"), None),
])
def test_canonical_uuid(spark, given, want):
    assert one(spark, given, S.canonical_uuid) == want


@pytest.mark.parametrize("given, want", [
    (None, None), ("", None),
    ("1.2.3.4", "6694f83c9f476da31f5df6bcc520034e7e57d421d247b9d34f49edbfc84a764c"),
])
def test_hash_ip(spark, given, want):
    assert one(spark, given, S.hash_ip) == want


@pytest.mark.parametrize("forwarded, peer, want", [
    (" 1.1.1.1 , 2.2.2.2", "3.3.3.3", "1.1.1.1"), ("", "3.3.3.3", "3.3.3.3"),
    (None, None, "unknown"), (None, "3.3.3.3", "3.3.3.3"), ("\t1.1.1.1", None, "1.1.1.1"),
])
def test_client_ip(spark, forwarded, peer, want):
    df = spark.createDataFrame([(forwarded, peer)], "f string, p string")
    assert df.select(S.client_ip("f", "p")).first()[0] == want


@pytest.mark.parametrize("text", [
    "2024-01-01", "20240101", "2024-01-01T10", "2024-01-01 10:20", "2024-01-01T10:20:30",
    "20240101T102030", "2024-01-01T10:20:30.5", "2024-01-01T10:20:30,123456",
    "2024-01-01T10:20:30Z", "2024-01-01T10:20:30+02:00", "2024-01-01T10:20+0530",
    "2024-01-01T10:20:30.123456789", "yesterday", "2024", "2024-13-01", "2024-01-01T25:00",
    "2024-02-30", "",
])
def test_parse_client_ts_reads_what_python_reads(spark, text):
    try:
        want = datetime.fromisoformat(text)
        want = (want - want.utcoffset()).replace(tzinfo=None) if want.tzinfo else want
    except ValueError:
        want = None
    got = one(spark, text, lambda c: F.date_format(S.parse_client_ts(c),
                                                   "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    assert got == (want and want.isoformat(timespec="microseconds"))


@pytest.mark.parametrize("part, whole, want", [
    (1, 3, 0.3333), (2, 3, 0.6667), (0, 5, 0.0), (5, 0, None), (7, 5, 1.4),
])
def test_ratio(spark, part, whole, want):
    df = spark.createDataFrame([(part, whole)], "p bigint, w bigint")
    assert df.select(S.ratio_double(F.col("p"), F.col("w"))).first()[0] == want


def test_rate_of_empty_cohort_is_zero(spark):
    df = spark.createDataFrame([(0, 0)], "p bigint, w bigint")
    assert str(df.select(S.rate_decimal(F.col("p"), F.col("w"))).first()[0]) == "0.0000"
