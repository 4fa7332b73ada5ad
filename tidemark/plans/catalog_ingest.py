"""Registered queries: sources, contract, dedup, reliability."""

import uuid

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import activity, contract, dedup, reliability, users
from tidemark.plans.catalog import micros, query, text
from tidemark.plans.testdata import Tables, duck_uuid
from tidemark.schemas import RAW_EVENTS
from tidemark.session import shared_dir
from tidemark.sources import events as sources
from tidemark.sources import tables as store
from tidemark.streaming.ingest import IngestTables


def scratch(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/runs/{uuid.uuid4().hex}"


# -- sources and sinks -------------------------------------------------------------------------

@query("scan_events", """
SELECT event_id, user_id, event_type, epoch_us(ts) AS server_us,
       CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date FROM events""")
def scan_events(t: Tables):
    df = sources.read_events(t.spark, f"{t.folder}/events.parquet", RAW_EVENTS, "ts")
    return df.select("event_id", "user_id", "event_type", micros("ts", "server_us"),
                     text("event_date"))


@query("encode_envelope", """
SELECT n, event_id, CAST(user_id AS VARCHAR) AS user_id, session_id, event_type,
       CAST(json_extract(properties, '$.k') AS BIGINT) AS k FROM std""", ("std",))
def encode_envelope(t: Tables):
    sent = contract.encode_envelope(t.std.select("n", "event_id", "user_id", "session_id",
                                                 "event_type", "properties"))
    return sent.select("n", *[F.get_json_object("data", f"$.{f}").alias(f)
                              for f in ("event_id", "user_id", "session_id", "event_type")],
                       F.get_json_object("data", "$.properties.k").cast("bigint").alias("k"))


@query("decode_envelope", """
SELECT message_id, event_id, user_id, session_id, event_type, client_ts, parse_error,
       CASE WHEN parse_error THEN data END AS raw FROM decoded""", ("decoded",))
def decode_envelope(t: Tables):
    return t.decoded.select("message_id", "event_id", "user_id", "session_id", "event_type",
                            "client_ts", F.col("_parse_error").alias("parse_error"),
                            F.col("_raw").alias("raw"))


@query("append_events", """
SELECT event_id, epoch_us(min(arrival_ts)) AS arrival_us FROM arrivals
WHERE event_id NOT IN (SELECT event_id FROM stored) GROUP BY event_id""",
       ("arrivals", "stored"))
def append_events(t: Tables):
    inserted = store.append_events(t.arrivals, t.stored, order="arrival_ts")
    return inserted.select("event_id", micros("arrival_ts", "arrival_us"))


@query("event_table_round_trip", """
SELECT event_id, CAST(CAST(server_ts AS DATE) AS VARCHAR) AS event_date, event_type FROM std""",
       ("std",))
def event_table_round_trip(t: Tables):
    """Two batches into the event table, the second one written twice."""
    path = IngestTables(scratch(t)).events
    store.write_events(store.append_events(t.stored, store.read_stored_events(t.spark, path)),
                       path, 0)
    for _ in range(2):
        known = store.read_stored_events(t.spark, path, before=1)
        store.write_events(
            store.append_events(t.arrivals, known, order="arrival_ts"), path, 1)
    return store.read_stored_events(t.spark, path).select("event_id", text("event_date"),
                                                          "event_type")


@query("dead_letter_sink", """
SELECT CAST(message_id AS VARCHAR) AS original_id, verdict AS reason,
       CAST(delivery_count AS VARCHAR) AS delivery_count,
       CASE WHEN parse_error THEN data END AS raw,
       CASE WHEN NOT parse_error AND data <> '' THEN session_id END AS session_id
FROM routed WHERE route = 'dlq'""", ("routed",))
def dead_letter_sink(t: Tables):
    letters = reliability.to_dead_letter(reliability.route_messages(t.classified))
    return letters.select("original_id", "reason", "delivery_count",
                          F.get_json_object("data", "$._raw").alias("raw"),
                          F.get_json_object("data", "$.session_id").alias("session_id"))


@query("retention_cap", """
, d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1),
c AS (SELECT day, n, coalesce(sum(n) OVER (ORDER BY day DESC
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS newer FROM d)
SELECT CAST(day AS VARCHAR) AS day, n FROM c WHERE newer < 3000""")
def retention_cap(t: Tables):
    kept = reliability.retain_newest(t.events, 3000, "ts")
    return kept.groupBy(F.to_date("ts").cast("string").alias("day")).agg(
        F.count("*").alias("n"))


@query("retention_cap_exact", """
SELECT event_id FROM events ORDER BY ts DESC LIMIT 3000""")
def retention_cap_exact(t: Tables):
    return reliability.retain_newest(t.events, 3000, "ts", exact=True).select("event_id")


@query("event_by_id", """
SELECT event_id, user_id, session_id, event_type, properties, epoch_us(server_ts) AS server_us
FROM std WHERE event_id = '00000000-0000-4000-8000-000000000007'""", ("std",))
def event_by_id(t: Tables):
    found = activity.event_by_id(t.std, "00000000-0000-4000-8000-000000000007")
    return found.select("event_id", "user_id", "session_id", "event_type", "properties",
                        micros("server_ts", "server_us"))


# -- scalar functions --------------------------------------------------------------------------

@query("hash_ip", """
SELECT n, CASE WHEN n % 10 < 2 THEN NULL ELSE sha256(ip) END AS ip_hash FROM access_log""",
       ("access_log",))
def hash_ip(t: Tables):
    ip = F.expr("CASE n % 10 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE ip END")
    return t.access_log.select("n", S.hash_ip(ip).alias("ip_hash"))


@query("forwarded_ip", """
SELECT n, CASE WHEN n % 3 = 1 THEN '10.1.0.' || CAST(n % 200 AS VARCHAR)
               WHEN n % 5 = 0 THEN 'unknown' ELSE ip END AS client_ip FROM access_log""",
       ("access_log",))
def forwarded_ip(t: Tables):
    forwarded = F.expr("CASE n % 3 WHEN 0 THEN NULL WHEN 1 THEN"
                       " concat(' 10.1.0.', n % 200, ' , 10.2.0.1') ELSE '' END")
    peer = F.expr("CASE WHEN n % 5 = 0 THEN NULL ELSE ip END")
    return t.access_log.select("n", S.client_ip(forwarded, peer).alias("client_ip"))


@query("normalize_path", """
SELECT n, substring(CASE n % 4
           WHEN 0 THEN CASE WHEN n % 3 = 0 THEN '/api/v1/events/{id}' WHEN n % 3 = 1
                THEN '/api/v1/admin/users/{id}' ELSE '/health' END
           WHEN 1 THEN '/a/{id}ab/{id}' WHEN 2 THEN '/api/v1/x'
           ELSE '/long/' || repeat('x', 200) END, 1, 120) AS path
FROM access_log""", ("access_log",))
def normalize_path(t: Tables):
    path = F.expr("CASE n % 4 WHEN 0 THEN path WHEN 1 THEN concat('/a/', n, 'ab/', n)"
                  " WHEN 2 THEN '/api/v1/x' ELSE concat('/long/', repeat('x', 200)) END")
    return t.access_log.select("n", S.normalize_path(path).alias("path"))


@query("validate_event", """
SELECT message_id, concat_ws(',',
  CASE WHEN euuid IS NULL THEN 'event_id' END,
  CASE WHEN user_id IS NOT NULL AND uuuid IS NULL THEN 'user_id' END,
  CASE WHEN coalesce(length(session_id), 0) NOT BETWEEN 1 AND 64 OR message_id % 50 = 14
       THEN 'session_id' END,
  CASE WHEN event_type IS NULL OR event_type NOT IN ('view','search','add_to_cart','order')
       THEN 'event_type' END,
  CASE WHEN message_id % 50 = 17 THEN 'properties' END,
  CASE WHEN client_ts = 'yesterday' THEN 'client_ts' END) AS errors
FROM (SELECT *, """ + duck_uuid("event_id") + " AS euuid, " + duck_uuid("user_id")
       + " AS uuuid FROM decoded)", ("decoded",))
def validate_event(t: Tables):
    checked = contract.validate_event(t.decoded)
    return checked.select("message_id", F.concat_ws(",", "errors").alias("errors"))


@query("classify_for_write", """
SELECT message_id, verdict, eid AS event_id, CASE WHEN user_id <> '' THEN uid END AS user_id,
       CASE WHEN client_ts LIKE '2024-01-01T05%'
            THEN epoch_us(TIMESTAMP '2024-01-01 03:00:00') END AS client_us
FROM classified""", ("classified",))
def classify_for_write(t: Tables):
    return t.classified.select("message_id", "verdict", "event_id", "user_id",
                               micros("client_ts", "client_us"))


@query("parse_client_ts", """
SELECT event_id, CASE event_id % 8
  WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) WHEN 2 THEN epoch_us(date_trunc('second', ts))
  WHEN 3 THEN epoch_us(date_trunc('day', ts)) WHEN 4 THEN epoch_us(ts - INTERVAL 2 HOUR)
  WHEN 5 THEN NULL WHEN 6 THEN epoch_us(date_trunc('minute', ts) - INTERVAL 330 MINUTE) END
  AS client_us FROM events""")
def parse_client_ts(t: Tables):
    given = F.expr(r"""CASE event_id % 8
      WHEN 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
      WHEN 1 THEN date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS'Z'")
      WHEN 2 THEN date_format(ts, "yyyyMMdd'T'HHmmss")
      WHEN 3 THEN date_format(ts, "yyyy-MM-dd")
      WHEN 4 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")
      WHEN 5 THEN 'yesterday'
      WHEN 6 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm'+0530'")
      ELSE date_format(ts, "yyyy-MM") END""")
    return t.events.select(
        "event_id", F.unix_micros(S.parse_client_ts(given)).alias("client_us"))


@query("canonical_uuid", """
SELECT n, CASE WHEN n % 6 = 5 THEN NULL ELSE concat('00000000-0000-4000-abcd-', lpad(
    cast(n AS varchar), 12, '0')) END AS event_id FROM std""", ("std",))
def canonical_uuid(t: Tables):
    plain = "concat('00000000-0000-4000-abcd-', lpad(cast(n AS string), 12, '0'))"
    given = F.expr(f"""CASE n % 6 WHEN 0 THEN {plain} WHEN 1 THEN upper({plain})
      WHEN 2 THEN replace({plain}, '-', '') WHEN 3 THEN concat('urn:uuid:', {plain})
      WHEN 4 THEN concat('{{', upper({plain}), '}}') ELSE concat({plain}, '0') END""")
    return t.std.select("n", S.canonical_uuid(given).alias("event_id"))


@query("stamp_server_ts", """
SELECT n, CASE WHEN n % 4 = 0 THEN '{}' ELSE properties END AS properties,
       (SELECT epoch_us(t) FROM now) AS server_us FROM std""", ("std", "now"))
def stamp_server_ts(t: Tables):
    bare = t.std.withColumn("properties", F.expr("CASE WHEN n % 4 <> 0 THEN properties END"))
    return contract.stamp_server_ts(bare, t.now).select(
        "n", "properties", micros("server_ts", "server_us"))


# -- filters -----------------------------------------------------------------------------------

@query("utc_day_range", """
SELECT n, event_type FROM std WHERE server_ts >= TIMESTAMP '2024-01-10 00:00:00'
  AND server_ts < TIMESTAMP '2024-01-13 00:00:00'""", ("std",))
def utc_day_range(t: Tables):
    return users.in_days(t.std, "2024-01-10", "2024-01-12").select("n", "event_type")


@query("known_users", "SELECT n, user_id FROM std WHERE user_id IS NOT NULL", ("std",))
def known_users(t: Tables):
    return users.known_users(t.std).select("n", "user_id")


@query("properties_filter", """
SELECT n FROM std WHERE CAST(json_extract(properties, '$.k') AS BIGINT) = 42""", ("std",))
def properties_filter(t: Tables):
    return activity.has_property(t.std, "$.k", 42).select("n")


@query("properties_filter_promoted", """
SELECT n FROM std WHERE CAST(json_extract(properties, '$.k') AS BIGINT) = 42""", ("std",))
def properties_filter_promoted(t: Tables):
    """The same filter over files that hold the property in a column of its own."""
    path, paths = scratch(t), {"$.k": "bigint"}
    activity.promote_properties(t.std, paths).write.options(
        **activity.bloom_filters(paths)).parquet(path)
    return activity.has_property(t.spark.read.parquet(path), "$.k", 42).select("n")


@query("session_events", """
SELECT n, event_type FROM std WHERE session_id = 's-8-2024-01-01'""", ("std",))
def session_events(t: Tables):
    return activity.session_events(t.std, "s-8-2024-01-01").select("n", "event_type")


_SENT_USER = ("CASE WHEN user_id IS NULL THEN NULL ELSE concat('00000000-0000-4000-9000-', "
              "lpad(cast(user_id AS varchar(20)), 12, '0')) END")
_SENT_TIME = "CASE WHEN n % 97 = 0 THEN 'yesterday' END"
_LONG = "cast(floor(n / 150) AS int)"  # every tenth run of 150 events is one batch, too long
_DUCK_BATCHES = f"""
, sent AS (
  SELECT n, event_id, session_id, event_type, properties, {_SENT_USER} AS user_id,
         {_SENT_TIME} AS client_ts FROM std),
members AS (
  SELECT session_id AS batch_id, * EXCLUDE n FROM sent
  UNION ALL SELECT concat('long-', {_LONG}), * EXCLUDE n FROM sent WHERE {_LONG} % 10 = 0),
sizes AS (
  SELECT batch_id, count(*) AS n,
         bool_or(event_type = 'error' OR client_ts IS NOT NULL) AS bad
  FROM members GROUP BY 1
  UNION ALL SELECT 'empty-' || c_custkey, 0, false FROM customer),
verdicts AS (
  SELECT batch_id, CASE WHEN n = 0 THEN 'empty_batch' WHEN n > 100 THEN 'batch_too_large'
                        WHEN bad THEN 'invalid_event' END AS reason FROM sizes)
"""


def batches(t: Tables):
    """One batch per session, batches that are too long, and empty ones."""
    sent = t.std.select(
        "n", "event_id", F.expr(_SENT_USER).alias("user_id"), "session_id", "event_type",
        F.parse_json("properties").alias("properties"), F.expr(_SENT_TIME).alias("client_ts"))
    event = F.struct(*[c for c in sent.columns if c != "n"]).alias("e")
    long = F.expr(_LONG)
    members = sent.select(F.col("session_id").alias("batch_id"), event).unionByName(
        sent.filter(long % 10 == 0).select(F.concat(F.lit("long-"), long).alias("batch_id"), event))
    body = F.to_json(F.struct(F.collect_list("e").alias("events")))
    filled = members.groupBy("batch_id").agg(body.alias("body"))
    empty = t.customer.select(F.concat(F.lit("empty-"), "c_custkey").alias("batch_id"),
                              F.lit('{"events": []}').alias("body"))
    return filled.unionByName(empty)


@query("explode_batch", _DUCK_BATCHES + """
SELECT m.batch_id, m.event_id, m.user_id, m.session_id, m.event_type, m.client_ts,
       CAST(json_extract(m.properties, '$.k') AS BIGINT) AS k
FROM members m JOIN verdicts v USING (batch_id)
WHERE v.reason IS NULL""", ("std",))
def explode_batch(t: Tables):
    rows, _ = contract.explode_batches(batches(t))
    return rows.select(
        "batch_id", "event_id", "user_id", "session_id", "event_type",
        F.col("client_ts").cast("string").alias("client_ts"),
        F.get_json_object(F.col("properties").cast("string"), "$.k").cast("bigint").alias("k"))


@query("explode_batch_rejected", _DUCK_BATCHES + """
SELECT batch_id, reason FROM verdicts WHERE reason IS NOT NULL""", ("std",))
def explode_batch_rejected(t: Tables):
    _, rejected = contract.explode_batches(batches(t))
    return rejected.select("batch_id", "reason")


@query("oversize_records", """
SELECT doc_id, strlen(text) AS bytes, CASE WHEN strlen(text) > 4096
       THEN 'payload_too_large' END AS reason FROM documents""")
def oversize_records(t: Tables):
    docs = t.documents.select("doc_id", F.col("text").alias("data"))
    kept, rejected = contract.split_oversize(docs, 4096)
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected).select(
        "doc_id", F.octet_length("data").cast("bigint").alias("bytes"), "reason")


# -- dedup and upsert --------------------------------------------------------------------------

@query("dedup_first", """
SELECT event_id, epoch_us(min(arrival_ts)) AS arrival_us FROM arrivals GROUP BY 1""",
       ("arrivals",))
def dedup_first(t: Tables):
    return dedup.dedup_first(t.arrivals).select("event_id", micros("arrival_ts", "arrival_us"))


@query("new_events_only", """
SELECT event_id, epoch_us(arrival_ts) AS arrival_us FROM arrivals
WHERE event_id NOT IN (SELECT event_id FROM stored)""", ("arrivals", "stored"))
def new_events_only(t: Tables):
    return dedup.new_events_only(t.arrivals, t.stored).select(
        "event_id", micros("arrival_ts", "arrival_us"))


_DUCK_OUTCOME = """
, ranked AS (
  SELECT a.*, row_number() OVER (PARTITION BY event_id ORDER BY arrival_ts) > 1
         OR event_id IN (SELECT event_id FROM stored) AS deduplicated FROM arrivals a)
"""


@query("ingest_outcome", _DUCK_OUTCOME + """
SELECT event_id, epoch_us(arrival_ts) AS arrival_us, deduplicated, 'sync' AS mode,
       CASE WHEN deduplicated THEN 'deduplicated' ELSE 'accepted' END AS status
FROM ranked""", ("arrivals", "stored"))
def ingest_outcome(t: Tables):
    return dedup.ingest_outcome(t.arrivals, t.stored, "sync").select(
        "event_id", micros("arrival_ts", "arrival_us"), "deduplicated", "mode", "status")


DUCK_CLAIMS = """
, taken AS (
  SELECT event_id, arrival_ts, n % 7 = 0 AND arrival_ts = server_ts + INTERVAL 1 HOUR AS dup
  FROM arrivals)
SELECT event_id, epoch_us(arrival_ts) AS arrival_us, dup AS deduplicated, 'async' AS mode,
       CASE WHEN dup THEN 'deduplicated' ELSE 'queued' END AS status FROM taken"""


@query("ingest_outcome_claim_ttl", DUCK_CLAIMS, ("arrivals",))
def ingest_outcome_claim_ttl(t: Tables):
    """Claims end after a day: the replay 25 hours later is queued again."""
    return dedup.ingest_outcome(t.arrivals, t.stored, "async", claim_ttl_seconds=86_400).select(
        "event_id", micros("arrival_ts", "arrival_us"), "deduplicated", "mode", "status")


@query("batch_outcome", _DUCK_OUTCOME + """
SELECT CAST(CAST(arrival_ts AS DATE) AS VARCHAR) AS day,
       count(*) FILTER (WHERE NOT deduplicated) AS accepted,
       count(*) FILTER (WHERE deduplicated) AS deduplicated FROM ranked GROUP BY 1""",
       ("arrivals", "stored"))
def batch_outcome(t: Tables):
    outcomes = dedup.ingest_outcome(t.arrivals, t.stored, "async")
    return dedup.batch_outcome(
        outcomes.withColumn("day", F.to_date("arrival_ts").cast("string")), "day")


_DUCK_KEYS = """
, keys AS (SELECT 'idem:' || event_id AS key, ts + INTERVAL 24 HOUR AS expires_at FROM events)
"""


def idempotency_keys(t: Tables):
    return t.events.select(
        F.concat(F.lit("idem:"), "event_id").alias("key"), F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_dt_interval(hours=F.lit(24))).alias("expires_at"))


@query("expire_keys", _DUCK_KEYS + """
SELECT key FROM keys WHERE expires_at >= (SELECT t FROM now) - INTERVAL 48 HOUR""", ("now",))
def expire_keys(t: Tables):
    kept, _ = dedup.expire_keys(idempotency_keys(t), t.now)
    return kept.select("key")


@query("expire_keys_deleted", _DUCK_KEYS + """
SELECT count(*) AS deleted FROM keys
WHERE expires_at < (SELECT t FROM now) - INTERVAL 48 HOUR""", ("now",))
def expire_keys_deleted(t: Tables):
    _, gone = dedup.expire_keys(idempotency_keys(t), t.now)
    return gone.agg(F.count("*").alias("deleted"))


@query("upsert_snapshot", """
SELECT CAST(CAST(server_ts AS DATE) AS VARCHAR) AS metric_date, 'dau' AS name,
       CAST(count(DISTINCT user_id) AS DOUBLE) AS value,
       CASE WHEN CAST(server_ts AS DATE) >= DATE '2024-01-10' THEN 'second' ELSE 'first' END
       AS written
FROM std GROUP BY 1, 2, 4""", ("std",))
def upsert_snapshot(t: Tables):
    """Days 1-15 are stored (with a wrong value), days 10-30 come in as updates."""
    path = scratch(t)
    keys = ["metric_date", "name", "dim_hash"]
    early = users.dau_series(t.std, "2024-01-01", "2024-01-15", computed_at="2024-01-15")
    wrong = F.when(F.col("metric_date") >= "2024-01-10", -1).otherwise(0)
    store.upsert_snapshot(t.spark, path, early.withColumn(
        "value", (F.col("value") + wrong).cast("decimal(20,4)")), keys)
    late = users.dau_series(t.std, "2024-01-10", "2024-01-30", computed_at="2024-01-31")
    # Each update also comes once more, older and wrong.
    older = late.withColumns({
        "value": (F.col("value") + 7).cast("decimal(20,4)"),
        "computed_at": F.col("computed_at") - F.make_dt_interval(days=F.lit(1))})
    table = store.upsert_snapshot(t.spark, path, late.unionByName(older), keys)
    return table.select(
        text("metric_date"), "name", F.col("value").cast("double").alias("value"),
        F.when(F.col("computed_at") > "2024-01-20", "second").otherwise("first")
        .alias("written"))


# Changes: the stored version, a stale one, an unknown user, a role outside the list, a role
# without a row, and a second change to the same user.
_CHANGE_COLUMNS = [
    "CASE WHEN c_custkey % 7 = 1 THEN -c_custkey ELSE c_custkey END AS id",
    "CASE WHEN c_custkey % 7 = 2 THEN 2 ELSE 1 END AS version",
    "CASE WHEN c_custkey % 7 = 3 THEN 'root' WHEN c_custkey % 7 = 4 THEN 'analyst' END AS role",
    "CASE WHEN c_custkey % 7 = 5 THEN 'Renamed' END AS full_name",
    "CASE WHEN c_custkey % 7 = 6 THEN false END AS is_active",
    "c_custkey AS arrival",
]
_DUCK_CHANGES = f"""
, first_changes AS (SELECT {', '.join(_CHANGE_COLUMNS)} FROM customer),
changes AS (SELECT * FROM first_changes UNION ALL
            SELECT id, 1, NULL, 'Too late', NULL, arrival + 1000000 FROM first_changes
            WHERE arrival % 5 = 0),
judged AS (SELECT c.*, CASE WHEN u.id IS NULL THEN 'not_found' WHEN c.role = 'root'
             THEN 'conflict' WHEN c.version <> u.version THEN 'version_conflict' END AS fault
           FROM changes c LEFT JOIN users u ON u.id = c.id),
ruled AS (SELECT *, CASE WHEN fault IS NOT NULL THEN fault WHEN arrival = min(
             CASE WHEN fault IS NULL THEN arrival END) OVER (PARTITION BY id) THEN 'applied'
             ELSE 'version_conflict' END AS outcome FROM judged)
"""


def changes(t: Tables):
    first = t.customer.selectExpr(*_CHANGE_COLUMNS)
    again = first.filter("arrival % 5 = 0").selectExpr(
        "id", "1 AS version", "CAST(NULL AS STRING) AS role", "'Too late' AS full_name",
        "CAST(NULL AS BOOLEAN) AS is_active", "arrival + 1000000 AS arrival")
    return first.unionByName(again)


@query("versioned_update", _DUCK_CHANGES + "SELECT id, arrival, outcome FROM ruled",
       ("users", "roles"))
def versioned_update(t: Tables):
    _, outcomes = dedup.versioned_update(t.users, changes(t), t.roles)
    return outcomes.select("id", "arrival", "outcome")


@query("versioned_update_table", _DUCK_CHANGES + """
SELECT u.id, coalesce(r.full_name, u.full_name) AS full_name,
       coalesce(r.is_active, u.is_active) AS is_active,
       CASE WHEN r.role = 'analyst' THEN 2 ELSE u.role_id END AS role_id,
       CAST(u.version + CASE WHEN r.id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS version
FROM users u LEFT JOIN (SELECT * FROM ruled WHERE outcome = 'applied') r ON r.id = u.id""",
       ("users", "roles"))
def versioned_update_table(t: Tables):
    table, _ = dedup.versioned_update(t.users, changes(t), t.roles)
    return table.select("id", "full_name", "is_active", "role_id", "version")


@query("insert_if_absent", """
SELECT email, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'new' END AS full_name
FROM (SELECT *, lower(c_name) || '@example.com' AS email FROM customer)""")
def insert_if_absent(t: Tables):
    known = t.users.filter("id % 2 = 0").select("email", "full_name")
    rows = t.users.select("email", F.lit("new").alias("full_name"))
    again = t.users.select("email", F.lit("newer").alias("full_name"))
    return dedup.insert_if_absent(known, rows.unionByName(again), "email")


# -- reliability -------------------------------------------------------------------------------

@query("route_messages", """
SELECT message_id, route, CASE WHEN route = 'dlq' THEN verdict END AS reason FROM routed""",
       ("routed",))
def route_messages(t: Tables):
    return reliability.route_messages(t.classified).select("message_id", "route", "reason")


def ledger(t: Tables):
    """Messages that were delivered and are not settled: the pending ones."""
    return reliability.route_messages(t.classified).filter("route = 'pending'").select(
        "message_id", "data", "delivery_count", "last_delivered")


_DUCK_LEDGER = ", ledger AS (SELECT * FROM routed WHERE route = 'pending')\n"


@query("reclaim_stale", _DUCK_LEDGER + """
SELECT message_id, CAST(delivery_count + 1 AS BIGINT) AS delivery_count,
       (SELECT epoch_us(t) FROM now) AS delivered_us FROM ledger
WHERE epoch_ms((SELECT t FROM now)) - epoch_ms(last_delivered) >= 60000
ORDER BY message_id LIMIT 100""", ("routed", "now"))
def reclaim_stale(t: Tables):
    return reliability.reclaim_stale(ledger(t), t.now).select(
        "message_id", F.col("delivery_count").cast("bigint").alias("delivery_count"),
        micros("last_delivered", "delivered_us"))


@query("ack_messages", """
SELECT message_id, CAST(delivery_count AS BIGINT) AS delivery_count FROM routed
WHERE route = 'pending'""", ("routed",))
def ack_messages(t: Tables):
    routed = reliability.route_messages(t.classified)
    done = routed.filter("route <> 'pending'")
    return reliability.ack_messages(t.messages, done).select(
        "message_id", F.col("delivery_count").cast("bigint").alias("delivery_count"))


def stats(t: Tables):
    letters = reliability.to_dead_letter(reliability.route_messages(t.classified))
    return reliability.queue_stats(t.messages, ledger(t), letters, last_delivered_id=500)


@query("queue_stats", """
SELECT 'stream:events' AS stream, 'cg:event-writers' AS "group", count(*) AS length,
       count(*) FILTER (WHERE route = 'pending') AS pending,
       count(*) FILTER (WHERE message_id > 500) AS lag,
       count(*) FILTER (WHERE route = 'dlq') AS dlq_length FROM routed""", ("routed",))
def queue_stats(t: Tables):
    return stats(t)


@query("write_batch_counts", """
SELECT count(*) FILTER (WHERE route = 'write') AS processed,
       count(*) FILTER (WHERE route = 'write' AND eid NOT IN (SELECT event_id FROM stored))
           AS inserted,
       count(*) FILTER (WHERE route = 'write' AND eid IN (SELECT event_id FROM stored))
           AS conflicts,
       count(*) FILTER (WHERE delivery_count > 1) AS reclaimed,
       count(*) FILTER (WHERE route = 'dlq') AS dead_lettered FROM routed""",
       ("routed", "stored"))
def write_batch_counts(t: Tables):
    routed = reliability.route_messages(t.classified)
    inserted = store.append_events(routed.filter("route = 'write'"), t.stored,
                                   order="message_id")
    return reliability.batch_counts(routed, inserted)
