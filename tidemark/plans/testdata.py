"""Inputs of the registered queries, derived by Spark from the given tables.

The given event table has integer ids, other type names and neither replays nor broken
messages, so those are derived here: as Spark SQL expressions, and for the check side as the
same expressions in DuckDB. All of them run over the whole table.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scalars as S
from tidemark.operators import contract
from tidemark.session import configure

# One text for both engines.
STD_COLUMNS = [
    "concat('00000000-0000-4000-8000-', lpad(cast(event_id AS varchar(20)), 12, '0')) AS event_id",
    "CASE WHEN event_id % 20 = 0 THEN NULL ELSE user_id END AS user_id",
    "concat('s-', cast(user_id AS varchar(20)), '-', cast(cast(ts AS date) AS varchar(20)))"
    " AS session_id",
    "CASE event_type WHEN 'click' THEN 'search' WHEN 'signup' THEN 'add_to_cart'"
    " WHEN 'purchase' THEN 'order' ELSE event_type END AS event_type",
    "props AS properties",
    "ts AS server_ts",
    "event_id AS n",
]

ACCESS_COLUMNS = [
    "event_id AS n",
    "ts",
    "CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method",
    "CASE WHEN event_id % 3 = 0 THEN concat('/api/v1/events/00000000-0000-4000-8000-',"
    " lpad(cast(event_id AS varchar(20)), 12, '0'))"
    " WHEN event_id % 3 = 1 THEN concat('/api/v1/admin/users/', cast(user_id AS varchar(20)))"
    " ELSE '/health' END AS path",
    "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status",
    "value / 100 AS duration_s",
    "concat('10.0.0.', cast(user_id % 50 AS varchar(20))) AS ip",
    "CASE WHEN event_id % 20 = 0 THEN NULL ELSE user_id END AS user_id",
    "event_type IN ('purchase', 'signup') AS event_write",
]

# Message fields; the last two are broken or respelled by position.
MESSAGE_EVENT_ID = (
    "CASE WHEN n % 50 = 4 THEN 'not-a-uuid' WHEN n % 50 = 9 THEN replace(event_id, '-', '')"
    " WHEN n % 50 = 10 THEN concat('urn:uuid:', event_id)"
    " WHEN n % 50 = 11 THEN concat('{', event_id, '}') ELSE event_id END"
)
MESSAGE_USER_ID = (
    "CASE WHEN n % 50 = 6 THEN 'x' WHEN user_id IS NULL THEN NULL"
    " ELSE concat('00000000-0000-4000-9000-', lpad(cast(user_id AS varchar(20)), 12, '0')) END"
)
MESSAGE_SESSION = "CASE WHEN n % 50 = 5 THEN NULL ELSE session_id END"
MESSAGE_CLIENT_TS = (
    "CASE WHEN n % 50 = 7 THEN 'yesterday'"
    " WHEN n % 50 = 8 THEN '2024-01-01T05:00:00+02:00' ELSE NULL END"
)
# Payloads with fields of the wrong JSON kind, or too long, by position.
_WRONG_FIELDS = {
    12: '"user_id":7,"session_id":"s","event_type":"view","properties":{}',
    13: '"session_id":"s","event_type":"view","properties":{},"client_ts":1704067200',
    14: '"session_id":7,"event_type":"view","properties":{}',
    15: '"session_id":"s","event_type":["view"],"properties":{}',
    16: '"session_id":"' + "x" * 65 + '","event_type":"view","properties":{}',
    17: '"session_id":"s","event_type":"view","properties":[1]',
}
MESSAGE_BROKEN = (
    "CASE WHEN n % 50 = 1 THEN '{bad' WHEN n % 50 = 2 THEN '' WHEN n % 50 = 3 THEN '[]'"
    + "".join(
        f" WHEN n % 50 = {i} THEN concat('{{\"event_id\":\"00000000-0000-4000-8000-',"
        f" lpad(cast(n AS varchar(20)), 12, '0'), '\",{rest}}}')"
        for i, rest in _WRONG_FIELDS.items())
    + " ELSE data END"
)

ARRIVAL_COPIES = (
    "SELECT *, server_ts AS arrival_ts FROM std UNION ALL "
    "SELECT *, server_ts + INTERVAL 1 HOUR FROM std WHERE n % 7 = 0 UNION ALL "
    "SELECT *, server_ts + INTERVAL 25 HOUR FROM std WHERE n % 11 = 0"
)

_DUCK_MESSAGES = f"""
SELECT n AS message_id, {MESSAGE_BROKEN} AS data, 1 + n % 6 AS delivery_count,
       server_ts AS last_delivered
FROM (SELECT n, server_ts,
             CAST(json_object('event_id', {MESSAGE_EVENT_ID}, 'user_id', {MESSAGE_USER_ID},
                  'session_id', {MESSAGE_SESSION}, 'event_type', event_type,
                  'properties', CAST(properties AS JSON), 'client_ts', {MESSAGE_CLIENT_TS})
                  AS VARCHAR) AS data
      FROM std)"""

_DUCK_DECODED = """
SELECT message_id, delivery_count, last_delivered, data,
       coalesce(data <> '' AND NOT coalesce(json_valid(data) AND json_type(
           CASE WHEN json_valid(data) THEN data END) = 'OBJECT', false), false) AS parse_error,
       CASE WHEN json_valid(data) THEN json_extract_string(data, '$.event_id') END AS event_id,
       CASE WHEN json_valid(data) THEN json_extract_string(data, '$.user_id') END AS user_id,
       CASE WHEN json_valid(data) THEN json_extract_string(data, '$.session_id') END AS session_id,
       CASE WHEN json_valid(data) THEN json_extract_string(data, '$.event_type') END AS event_type,
       CASE WHEN json_valid(data) THEN json_extract_string(data, '$.properties') END AS properties,
       CASE WHEN json_valid(data) THEN json_extract_string(data, '$.client_ts') END AS client_ts
FROM messages"""

_HEX = "replace(regexp_replace(replace(lower({0}), 'urn:uuid:', ''), '[{{}}]', '', 'g'), '-', '')"
_UUID = (
    "CASE WHEN regexp_full_match(" + _HEX + ", '[0-9a-f]{{32}}') THEN regexp_replace(" + _HEX
    + ", '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') END"
)


def duck_uuid(column: str) -> str:
    return _UUID.format(column)


_DUCK_CLASSIFIED = f"""
SELECT *, {duck_uuid('event_id')} AS eid, {duck_uuid('user_id')} AS uid,
       CASE WHEN parse_error OR coalesce(event_id, '') = '' THEN 'invalid_payload'
            WHEN {duck_uuid('event_id')} IS NULL THEN 'invalid_event'
            WHEN coalesce(user_id, '') <> '' AND {duck_uuid('user_id')} IS NULL
                 THEN CASE WHEN message_id % 50 = 12 THEN 'exception:AttributeError'
                           ELSE 'exception:ValueError' END
            WHEN message_id % 50 = 13 THEN 'exception:TypeError'
            WHEN message_id % 50 IN (14, 15, 16) THEN 'exception:DBAPIError'
            WHEN coalesce(session_id, '') = '' OR coalesce(event_type, '') = ''
                 THEN 'invalid_event'
            ELSE 'ok' END AS verdict
FROM decoded"""

_DUCK_ROUTED = """
SELECT *, CASE WHEN verdict = 'ok' THEN 'write' WHEN delivery_count >= 5 THEN 'dlq'
               ELSE 'pending' END AS route
FROM classified"""

DUCK_NORMAL_PATH = (
    "substring(regexp_replace(regexp_replace(path, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-"
    "[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '{id}', 'g'), '/[0-9]+', '/{id}', 'g'),"
    " 1, 120)"
)

# Check-side tables in dependency order.
CTES = {
    "std": f"SELECT {', '.join(STD_COLUMNS)} FROM events",
    "arrivals": ARRIVAL_COPIES,
    "stored": "SELECT * FROM std WHERE server_ts < TIMESTAMP '2024-01-16 00:00:00'",
    "messages": _DUCK_MESSAGES,
    "decoded": _DUCK_DECODED,
    "classified": _DUCK_CLASSIFIED,
    "routed": _DUCK_ROUTED,
    "access_log": f"SELECT {', '.join(ACCESS_COLUMNS)} FROM events",
    "now": "SELECT max(ts) AS t FROM events",
}
_NEEDS = {
    "arrivals": ["std"], "stored": ["std"], "messages": ["std"], "decoded": ["messages"],
    "classified": ["decoded"], "routed": ["classified"],
}


def duck(body: str, *tables: str, recursive: bool = False) -> str:
    """A check query with the derived tables it uses in front.

    A body that needs tables of its own starts with a comma and continues the list.
    """
    names: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in names:
            names.append(name)

    for name in tables:
        add(name)
    body = body.strip()
    if not names and not body.startswith(","):
        return body
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + (f"{ctes}\n{body}" if ctes else body[1:])


class Tables:
    """The given tables of one folder and the inputs derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = configure(spark)
        self.folder = folder

    def _given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.spark.read.schema(schemas.RAW_EVENTS).parquet(
            f"{self.folder}/events.parquet")

    @cached_property
    def customer(self) -> DataFrame:
        return self._given("customer")

    @cached_property
    def documents(self) -> DataFrame:
        return self._given("documents")

    @cached_property
    def now(self):
        """The reference time: the newest event."""
        return self.events.agg(F.max("ts")).scalar()

    @cached_property
    def std(self) -> DataFrame:
        """The event contract's shape; `error` is left as an unknown type, and every 20th event
        is anonymous."""
        return self.events.selectExpr(*STD_COLUMNS)

    @cached_property
    def arrivals(self) -> DataFrame:
        """With replays one hour and 25 hours later."""
        copies = F.array_compact(F.array(
            F.lit(0), F.when(F.col("n") % 7 == 0, 1), F.when(F.col("n") % 11 == 0, 25)))
        return self.std.withColumn("_h", F.explode(copies)).withColumn(
            "arrival_ts", F.col("server_ts") + F.make_dt_interval(hours=F.col("_h"))).drop("_h")

    @cached_property
    def stored(self) -> DataFrame:
        """The first half of the month, as the table that later arrivals meet."""
        return self.std.filter(F.col("server_ts") < F.lit("2024-01-16").cast("timestamp_ntz"))

    @cached_property
    def messages(self) -> DataFrame:
        """One message per event, some broken, with delivery counts 1 to 6."""
        fields = self.std.select(
            "n", "server_ts", F.expr(MESSAGE_EVENT_ID).alias("event_id"),
            F.expr(MESSAGE_USER_ID).alias("user_id"),
            F.expr(MESSAGE_SESSION).alias("session_id"), "event_type", "properties",
            F.expr(MESSAGE_CLIENT_TS).alias("client_ts"),
        )
        sent = S.evaluated_once(contract.encode_envelope(fields),
                                {"data": F.expr(MESSAGE_BROKEN)})
        return sent.select(
            F.col("n").alias("message_id"), "data",
            (1 + F.col("n") % 6).alias("delivery_count"),
            F.col("server_ts").alias("last_delivered"),
        )

    @cached_property
    def decoded(self) -> DataFrame:
        return contract.decode_envelope(self.messages)

    @cached_property
    def classified(self) -> DataFrame:
        return contract.classify_for_write(self.decoded)

    @cached_property
    def access_log(self) -> DataFrame:
        return self.events.selectExpr(*ACCESS_COLUMNS)

    @cached_property
    def users(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("id"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.col("c_name").alias("full_name"),
            (F.col("c_custkey") % 3 + 1).alias("role_id"),
            F.lit(1).cast("bigint").alias("version"),
            (F.col("c_acctbal") > 0).alias("is_active"),
            (F.lit("2024-01-01").cast("timestamp_ntz")
             + F.make_dt_interval(mins=F.col("c_custkey").cast("int"))).alias("created_at"),
        )

    @cached_property
    def roles(self) -> DataFrame:
        return self.users.select(F.col("role_id").alias("id")).distinct().withColumn(
            "name", F.element_at(F.array(F.lit("admin"), F.lit("analyst"), F.lit("client_app")),
                                 F.col("id").cast("int")))


DUCK_USERS = (
    "SELECT c_custkey AS id, lower(c_name) || '@example.com' AS email, c_name AS full_name, "
    "c_custkey % 3 + 1 AS role_id, CAST(1 AS BIGINT) AS version, c_acctbal > 0 AS is_active, "
    "TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS created_at FROM customer"
)
DUCK_ROLES = (
    "SELECT DISTINCT c_custkey % 3 + 1 AS id, "
    "CASE c_custkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'analyst' ELSE 'client_app' END AS name "
    "FROM customer"
)
CTES["users"] = DUCK_USERS
CTES["roles"] = DUCK_ROLES
