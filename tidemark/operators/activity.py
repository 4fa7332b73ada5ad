"""Trailing event counts and single-event or single-session reads."""

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scalars as S
from tidemark.operators.users import since


def events_per_minute(events: DataFrame, as_of, ts_col: str = "server_ts") -> DataFrame:
    """Events at or after `as_of - 60 s`, anonymous ones included, as a double."""
    return since(events, S.before(as_of, 60, "secs"), ts_col).agg(
        F.count("*").cast("double").alias("events_per_minute")
    ).withColumn("window_seconds", F.lit(60))


def events_total(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events_total"))


def event_by_id(events: DataFrame, event_id, key: str = "event_id") -> DataFrame:
    """The public columns of one event; no row if it does not exist."""
    shown = [c for c in schemas.PUBLIC_EVENT_COLUMNS if c in events.columns]
    return events.filter(F.col(key) == event_id).select(*shown)


def event_exists(events: DataFrame, event_id, key: str = "event_id") -> DataFrame:
    """One row `found` that tells whether the id is stored."""
    hit = events.filter(F.col(key) == event_id).select(key).limit(1)
    return hit.agg((F.count("*") > 0).alias("found"))


def session_events(events: DataFrame, session_id: str, ts_col: str = "server_ts") -> DataFrame:
    """One session's events in time order."""
    return events.filter(F.col("session_id") == session_id).orderBy(ts_col, "event_id")


def _json_kind(value) -> str:
    return {bool: "boolean", int: "bigint", float: "double"}.get(type(value), "string")


def _property(path: str, kind: str, props_col: str) -> Column:
    return F.try_variant_get(F.try_parse_json(F.col(props_col)), path, kind)


def promoted_column(path: str, kind: str) -> str:
    """Name of the column that holds the property at `path` as `kind`; other letters are spelled out."""
    plain = re.sub("[^A-Za-z0-9]", lambda m: f"_{ord(m[0]):x}_", path.removeprefix("$"))
    return f"property_{kind}{plain}"


def promote_properties(events: DataFrame, paths: Mapping[str, str],
                       props_col: str = "properties") -> DataFrame:
    """Add a column for each property that is asked for often, `{path: kind}` with the kinds boolean,
    bigint, double and string. It holds what `has_property` would read from the JSON, so files and row
    groups without the value are skipped by their statistics and bloom filters."""
    return events.withColumns({promoted_column(p, k): _property(p, k, props_col)
                               for p, k in paths.items()})


def bloom_filters(paths: Mapping[str, str]) -> dict[str, str]:
    """Parquet options that give the promoted numbers and texts a bloom filter."""
    return {"parquet.bloom.filter.adaptive.enabled": "true", **{
        f"parquet.bloom.filter.enabled#{promoted_column(p, k)}": "true"
        for p, k in paths.items() if k != "boolean"}}


def has_property(events: DataFrame, path: str, value, props_col: str = "properties") -> DataFrame:
    """Events whose JSON properties hold `value` at `path` (`$.a.b`). A promoted property is compared in
    its column, any other is read from the JSON."""
    kind = _json_kind(value)
    promoted = promoted_column(path, kind)
    found = F.col(promoted) if promoted in events.columns else _property(path, kind, props_col)
    return events.filter(found == F.lit(value))
