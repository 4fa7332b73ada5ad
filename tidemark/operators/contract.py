"""The ingest contract: message decoding, strict and loose checks, batches, size limit.

Payload fields are read as VARIANT: one parse per message, the JSON kind of every field stays
known, and `properties` keeps whatever shape the sender gave it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config, schemas
from tidemark.functions import scalars as S


# -- wire form ---------------------------------------------------------------------------------

def encode_envelope(events: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One JSON text per event in `data`; ids as text, NULL fields written as null.

    `properties` holds JSON text and is embedded as JSON, not as a quoted string.
    """
    names = [f for f in (fields or schemas.PAYLOAD_FIELDS) if f in events.columns]

    def member(name: str) -> Column:
        if name == "properties":
            return F.coalesce(F.try_parse_json(F.col(name)), F.parse_json(F.lit("{}")))
        if name == "client_ts" and dict(events.dtypes)[name] != "string":
            return F.date_format(F.col(name).cast("timestamp"),
                                 "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        return F.col(name).cast("string")

    body = F.struct(*[member(n).alias(n) for n in names])
    rest = [c for c in events.columns if c not in schemas.PAYLOAD_FIELDS]
    return events.select(*rest, F.to_json(body, {"ignoreNullFields": "false"}).alias("data"))


_FIELDS_TYPE = "struct<" + ", ".join(f"{f}: variant" for f in schemas.PAYLOAD_FIELDS) + ">"
_JSON = {"allowSingleQuotes": "false"}


def _members(text: Column, kind: str) -> Column:
    """The text parsed as the only member of an array; NULL if that breaks.

    A parser stops at the end of the first value. Inside an array nothing may follow it: `{} x`
    is an error and `{},{}` has two members.
    """
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{kind}>", _JSON)


def _only(members: Column) -> Column:
    return F.get(members, F.lit(0))


def _is_whole(members: Column) -> Column:
    return F.coalesce((F.size(members) == 1) & _only(members).isNotNull(), F.lit(False))


def _field(payload: Column, name: str) -> Column:
    return payload[name].cast("string")


def _kind(payload: Column, name: str) -> Column:
    """JSON kind of a field: STRING, BIGINT, VOID, ARRAY<..>, OBJECT<..>; NULL if absent."""
    return F.schema_of_variant(payload[name])


def _truthy(kind: Column, text: Column) -> Column:
    """Whether a field carries something: not absent, null, empty, zero or false."""
    return F.coalesce(
        F.when(kind == "STRING", text != "")
        .when(kind == "VOID", F.lit(False))
        .when(kind == "BOOLEAN", text == "true")
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(text.try_cast("double") != 0),
        F.lit(False),
    )


def decode_envelope(messages: DataFrame) -> DataFrame:
    """Read the fields out of `data`.

    Missing or empty text is an empty payload, not an error. Text that is no JSON object sets
    `_parse_error` and is kept in `_raw`.
    """
    has_text = F.coalesce(F.col("data") != "", F.lit(False))
    parsed = messages.withColumn("_members", _members(F.col("data"), _FIELDS_TYPE))
    payload = _only(F.col("_members"))
    kinds = F.struct(*[
        _kind(payload, n).alias(n)
        for n in ("event_id", "user_id", "session_id", "event_type", "properties", "client_ts")
    ])
    return parsed.withColumns({
        **{n: _field(payload, n) for n in schemas.PAYLOAD_FIELDS},
        "_kinds": kinds,
        "_parse_error": has_text & ~_is_whole(F.col("_members")),
    }).drop("_members").withColumn("_raw", F.when(F.col("_parse_error"), F.col("data")))


# -- strict form: what a sender may submit -----------------------------------------------------

def _valid_time(text: Column) -> Column:
    """ISO text, or a number: seconds since 1970 up to 2e10, milliseconds beyond, as far as the
    year 9999."""
    number = F.when(text.rlike(r"^[+-]?\d+(\.\d+)?$"), text.try_cast("double"))
    seconds = F.when(F.abs(number) > 2e10, number / 1000).otherwise(number)
    in_range = F.coalesce(seconds.between(-62_135_596_800, 253_402_300_799), F.lit(False))
    return in_range | S.parse_client_ts(text).isNotNull()


def violations(get, kind=None, types=config.EVENT_TYPES, uuid_ids: bool = True) -> Column:
    """Names of the fields that break the contract, as an array.

    `get(name)` gives a field as text, `kind(name)` its JSON kind (omit for typed columns).
    """
    def is_kind(name: str, *allowed: str) -> Column:
        if kind is None:
            return F.lit(True)
        k = kind(name)
        ok = k.isNull() | F.lit(False)
        for a in allowed:
            ok = ok | k.startswith(a)
        return F.coalesce(ok, F.lit(True))

    def id_ok(name: str) -> Column:
        v = get(name)
        return S.canonical_uuid(v).isNotNull() if uuid_ids else v.isNotNull()

    session = get("session_id")
    rules = {
        "event_id": id_ok("event_id") & is_kind("event_id", "STRING"),
        "user_id": get("user_id").isNull()
        | (id_ok("user_id") & is_kind("user_id", "STRING", "VOID")),
        "session_id": session.isNotNull() & (F.length(session) >= 1)
        & (F.length(session) <= config.SESSION_ID_MAX) & is_kind("session_id", "STRING"),
        "event_type": get("event_type").isin(*types) & is_kind("event_type", "STRING"),
        "properties": (
            get("properties").isNull()
            | F.coalesce(F.schema_of_variant(F.try_parse_json(get("properties")))
                         .startswith("OBJECT"), F.lit(False))
            if kind is None else is_kind("properties", "OBJECT")
        ),
        "client_ts": get("client_ts").isNull() | _valid_time(get("client_ts")),
    }
    flags = [F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(name))
             for name, ok in rules.items()]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def validate_event(df: DataFrame, types=config.EVENT_TYPES, uuid_ids: bool = True) -> DataFrame:
    """Append `errors`, the fields that break the contract; empty means accepted.

    Accepts decoded messages (JSON kinds known) and plain text columns alike.
    """
    kind = (lambda n: F.col(f"_kinds.{n}")) if "_kinds" in df.columns else None

    def get(name: str) -> Column:
        return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")

    return df.withColumn("errors", violations(get, kind, types, uuid_ids))


# -- loose form: what the writer checks --------------------------------------------------------

def classify_for_write(decoded: DataFrame, uuid_ids: bool = True) -> DataFrame:
    """Append `verdict`: `ok` or the reason a message cannot be written.

    The event type is not compared with the list here, only the strict form does that. Ids come
    out canonical, `client_ts` as a soft-parsed timestamp, `properties` defaulted to `{}`.
    """
    def kind(n: str) -> Column:
        return F.col(f"_kinds.{n}")

    def truthy(n: str) -> Column:
        return _truthy(kind(n), F.col(n))

    def is_text(n: str) -> Column:
        return kind(n) == "STRING"

    def as_id(n: str) -> Column:
        return F.when(is_text(n), S.canonical_uuid(n) if uuid_ids else F.col(n))

    read = decoded.withColumns({
        "_has": F.struct(*[truthy(n).alias(n) for n in (
            "event_id", "user_id", "session_id", "event_type", "client_ts")]),
        "_event_id": as_id("event_id"),
        "_user_id": as_id("user_id"),
        "client_ts": F.when(is_text("client_ts"), S.parse_client_ts("client_ts")),
        "properties": F.when(truthy("properties"), F.col("properties")).otherwise("{}"),
    })

    def has(n: str) -> Column:
        return F.col(f"_has.{n}")

    too_long = (F.length("session_id") > config.SESSION_ID_MAX) | (
        F.length("event_type") > config.EVENT_TYPE_MAX) | F.coalesce(
        F.length("ip_hash") > config.IP_HASH_MAX, F.lit(False))
    # The reasons, as they appear in dead letters.
    verdict = (
        F.when(F.col("_parse_error") | ~has("event_id"), "invalid_payload")
        .when(F.col("_event_id").isNull(), "invalid_event")
        .when(has("user_id") & ~is_text("user_id"), "exception:AttributeError")
        .when(has("user_id") & F.col("_user_id").isNull(), "exception:ValueError")
        .when(has("client_ts") & ~is_text("client_ts"), "exception:TypeError")
        .when(~has("session_id") | ~has("event_type"), "invalid_event")
        # the table itself refuses these
        .when(~is_text("session_id") | ~is_text("event_type") | too_long,
              "exception:DBAPIError")
        .otherwise("ok")
    )
    # Filters on these reach back no further than here; see evaluated_once.
    fixed = {"verdict": verdict, "event_id": F.col("_event_id"), "user_id": F.col("_user_id")}
    return S.evaluated_once(read, fixed).drop("_has", "_event_id", "_user_id")


def stamp_server_ts(df: DataFrame, as_of=None) -> DataFrame:
    """Set the write time; a missing property object becomes `{}`."""
    now = F.current_timestamp() if as_of is None else S.at(as_of)
    out = df.withColumn("server_ts", now)
    if "properties" in df.columns:
        out = out.withColumn("properties", F.coalesce("properties", F.lit("{}")))
    return out


# -- batches and size --------------------------------------------------------------------------

def explode_batches(raw: DataFrame, types=config.EVENT_TYPES,
                    uuid_ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """Split `body = {"events": [..]}` records into event rows and rejected records.

    A record is taken or rejected as a whole. Its members are checked inside the record, so the
    decision needs no shuffle.
    """
    body = _members(F.col("body"), f"struct<events: array<{_FIELDS_TYPE}>>")

    def broken(v: Column) -> Column:
        return F.size(violations(
            lambda n: _field(v, n), lambda n: _kind(v, n), types, uuid_ids)) > 0

    count = F.coalesce(F.size("_members"), F.lit(0))
    parsed = raw.withColumn("_body", body)
    members = F.when(_is_whole(F.col("_body")), _only(F.col("_body"))["events"])
    checked = S.evaluated_once(parsed, {"_members": members}).drop("_body")
    checked = checked.withColumn(
        "reason",
        F.when(F.col("_members").isNull(), "invalid_body")
        .when(count < config.BATCH_MIN_EVENTS, "empty_batch")
        .when(count > config.BATCH_MAX_EVENTS, "batch_too_large")
        .when(F.exists("_members", lambda v: v.isNull() | broken(v)), "invalid_event"),
    )
    keep = [c for c in raw.columns if c != "body"]
    rows = (
        checked.filter(F.col("reason").isNull())
        .select(*keep, F.posexplode("_members").alias("position", "_event"))
        .select(*keep, "position",
                *[_field(F.col("_event"), n).alias(n) for n in schemas.PAYLOAD_FIELDS[:6]])
    )
    if uuid_ids:
        rows = rows.withColumns({n: S.canonical_uuid(n) for n in ("event_id", "user_id")})
    rejected = checked.filter(F.col("reason").isNotNull()).select(*raw.columns, "reason")
    return rows, rejected


def split_oversize(raw: DataFrame, max_bytes: int = config.MAX_BODY_BYTES,
                   text_col: str = "data") -> tuple[DataFrame, DataFrame]:
    """Records up to `max_bytes` pass; longer ones come back with a reason."""
    too_large = F.coalesce(F.octet_length(text_col) > max_bytes, F.lit(False))
    rejected = raw.filter(too_large).withColumn("reason", F.lit("payload_too_large"))
    return raw.filter(~too_large), rejected
