"""Live decisions that need state per key: sliding quotas and claims of ids.

Both answer every row in the batch that brings it. State is small: a quota keeps the allowed requests
of the last window, at most `limit` points per key, a claim keeps one time per id. A call into Python and
its state costs as much as the answers to hundreds of rows, so keys are put together in `groups` by their
hash: one call per group and batch reads, uses and writes the state of the group's keys as one Arrow
table. Keys that have gone quiet leave it at the group's next call, and an event-time timer clears a
group that gets none. More groups suit small batches over many live keys. Spark's own time to live goes by the clock, so a stream
that stands still, or reads a log again, would lose claims and windows that are not over; these timers
go by the rows' time.

Rows that come later than the watermark get no answer and are counted by the stream's progress; so are
times before 1970. A row that is older than its key's last one is judged at that one's time, as a live counter would.

A group's rows of one batch are decided in one task; only the key, the time and the columns asked for go
there. What bounds them is the size of a batch, `maxFilesPerTrigger` or `maxOffsetsPerTrigger`.
"""

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DoubleType, FloatType, StructField, StructType

from tidemark import config
from tidemark.operators.dedup import claim_times

# Python workers get the processors themselves and need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WATERMARK = "24 hours"
GROUPS = 1024
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State with timers and columns of its own needs the RocksDB store; call before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


_STATE = StructType([StructField("keys", BinaryType())])


def _read(state) -> dict[str, list]:
    """The columns of a group's state, a row per key; nothing if it has none."""
    if not state.exists():
        return {}
    return pa.ipc.open_stream(bytes(state.get()[0])).read_all().to_pydict()


def _write(state, schema: pa.Schema, columns: dict[str, list]) -> None:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.table(columns, schema))
    state.update((sink.getvalue().to_pybytes(),))


def _sorted(rows: Iterator[pd.DataFrame], columns: list[str], by: list[str]
            ) -> tuple[pd.DataFrame, list[str], np.ndarray, np.ndarray]:
    """A group's rows by key and then by `by`; its keys in this order, the place of every row's key among
    them, and where the rows of each key begin, with the number of rows behind the last one."""
    pdf = pd.concat(list(_named(rows, columns)), ignore_index=True)
    pdf["_key"], keys = pd.factorize(pdf["_key"], use_na_sentinel=False)
    pdf = pdf.sort_values(["_key", *by], kind="stable", ignore_index=True)
    of = pdf["_key"].to_numpy(np.int64)
    return pdf, [k if isinstance(k, str) else None for k in keys], of, np.searchsorted(of, np.arange(len(keys) + 1))


def decide(points: np.ndarray, counts: np.ndarray, kept_t: list[int], kept_n: list[int],
           limit: int, window_ms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Serve `counts` requests at each of the rising times `points`.

    `kept_t`, `kept_n` are the allowed requests so far by time and are brought up to date. Returns
    per point how many are allowed, how many allowed ones were in the window before them, and the
    oldest allowed one in the window then (the point itself without any).
    """
    n = len(points)
    allowed, before, oldest = (np.zeros(n, np.int64) for _ in range(3))
    first, held = 0, sum(kept_n)
    for i, (t, count) in enumerate(zip(points.tolist(), counts.tolist())):
        while first < len(kept_t) and kept_t[first] <= t - window_ms:
            held -= kept_n[first]
            first += 1
        granted = min(count, max(0, limit - held))
        allowed[i], before[i] = granted, held
        if granted:
            if kept_t and kept_t[-1] == t and len(kept_t) > first:
                kept_n[-1] += granted
            else:
                kept_t.append(t)
                kept_n.append(granted)
            held += granted
        oldest[i] = kept_t[first] if first < len(kept_t) else t
    del kept_t[:first], kept_n[:first]
    return allowed, before, oldest


def _named(rows: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The chunks under the columns' own names; Spark renames those that start with an underscore."""
    for pdf in rows:
        yield pdf.set_axis(columns, axis=1)


class _Quota(StatefulProcessor):
    def __init__(self, columns: list[str], ts_ms: str, order: list[str], limit: int, window_ms: int,
                 applies: str | None):
        self.columns, self.ts_ms, self.order, self.applies = columns, ts_ms, order, applies
        self.limit, self.window_ms = limit, window_ms
        # Per key the time of its last request, and the times and numbers of the allowed ones.
        self.schema = pa.schema([("key", pa.string()), ("last", pa.int64()),
                                 ("t", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.applies is not None and not key[0]:
            for pdf in _named(rows, self.columns):
                yield pdf.drop(columns=["_key", "_group"]).assign(allowed=True, count=0, reset_s=0)
            return
        kept = {k: (last, t, n) for k, last, t, n in zip(*_read(self.kept).values())}
        pdf, keys, of, starts = _sorted(rows, self.columns, [self.ts_ms, *self.order])
        now = pdf[self.ts_ms].to_numpy(np.int64)
        lasts = np.array([kept[k][0] if k in kept else np.iinfo(np.int64).min for k in keys])
        now = np.maximum(now, lasts[of])
        # A point is one time of one key, with all of its requests.
        first = np.flatnonzero(np.diff(of, prepend=-1).astype(bool)
                               | np.diff(now, prepend=now[0]).astype(bool))
        counts = np.diff(first, append=len(now))
        points, bounds = now[first], np.searchsorted(first, starts)
        granted, before, oldest = (np.zeros(len(points), np.int64) for _ in range(3))
        for k, lo, hi in zip(keys, bounds[:-1].tolist(), bounds[1:].tolist()):
            _, kept_t, kept_n = kept.get(k, (0, [], []))
            granted[lo:hi], before[lo:hi], oldest[lo:hi] = decide(
                points[lo:hi], counts[lo:hi], kept_t, kept_n, self.limit, self.window_ms)
            kept[k] = int(points[hi - 1]), kept_t, kept_n
        at = np.repeat(np.arange(len(points)), counts)
        place = np.arange(len(now)) - first[at] + 1
        allowed = place <= granted[at]
        wait = np.maximum(0, oldest[at] + self.window_ms - now) if self.limit else np.full(
            len(now), self.window_ms)
        pdf["allowed"] = allowed
        pdf["count"] = np.where(allowed, before[at] + place, self.limit)
        pdf["reset_s"] = -(-np.where(allowed, self.window_ms, wait) // 1000)
        # Only now, as a key's timer would: rows of this batch may be older than its watermark.
        live_from = timerValues.getCurrentWatermarkInMs() - self.window_ms
        live = {k: v for k, v in kept.items() if v[0] >= live_from}
        _write(self.kept, self.schema, {
            "key": list(live), **{c: [v[i] for v in live.values()]
                                  for i, c in enumerate(("last", "t", "n"))}})
        _renew(self.handle, max([live_from, *[v[0] for v in live.values()]]) + self.window_ms)
        yield pdf.drop(columns=["_key", "_group"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter([])

    def close(self) -> None:
        pass


def _renew(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """One timer per group, moved to its last use; the watermark is one ahead of the time."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at_ms + 1)


def _timed(stream: DataFrame, ts_ms: Column, watermark: str) -> DataFrame:
    # One more than the time itself: a stream's first watermark is 0, and a row there would be late.
    return stream.withColumn("_at", F.timestamp_millis(ts_ms + 1)).withWatermark("_at", watermark)


def _with(schema: StructType, columns: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(columns).fields])


_ANSWER = "allowed boolean, count long, reset_s long"


def _one_key(rows: DataFrame, keys: Sequence[str]) -> Column:
    """The key columns as one text; different keys have different texts."""
    def text(k: str) -> Column:
        kind = rows.schema[k].dataType
        if isinstance(kind, BinaryType):
            return F.hex(k)
        # Grouping takes the two zeros for one.
        return (F.col(k) + F.lit(0).cast(kind) if isinstance(kind, (DoubleType, FloatType))
                else F.col(k)).cast("string")

    if len(keys) == 1:
        return text(keys[0])
    return F.concat(*[part for k in keys for part in (F.length(text(k)), F.lit(":"), text(k))])


def _grouped(rows: DataFrame, key: Column, groups: int) -> DataFrame:
    return rows.withColumn("_key", key).withColumn(
        "_group", F.pmod(F.xxhash64("_key"), F.lit(groups)).cast("int"))


def _ruled(stream: DataFrame, key: Column, ts_ms: str, order: list[str], limit: int,
           window_ms: int, groups: int, applies: str | None = None) -> DataFrame:
    rows = _grouped(stream, key, groups)
    processor = _Quota(rows.columns, ts_ms, order, limit, window_ms, applies)
    grouped = rows.groupBy(*([applies] if applies else []), "_group")
    return grouped.transformWithStateInPandas(
        processor, _with(stream.schema, _ANSWER), "Append", "EventTime", eventTimeColumnName="_at")


def stream_quota(stream: DataFrame, key: str | Sequence[str], ts_ms: str, limit: int,
                 window_ms: int = config.QUOTA_WINDOW_SECONDS * 1000, order: Sequence[str] = (),
                 watermark: str = WATERMARK, groups: int = GROUPS) -> DataFrame:
    """The key columns, `ts_ms` and the `order` columns of every request with `allowed`, `count` and
    `reset_s`, as `operators.quota.sliding_quota` tells them for a log in time order.

    Requests without a key or a time are not limited and have no count.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = list(order)
    if not order:
        raise ValueError("order must name columns that identify a request")
    keep_state_on_disk(stream.sparkSession)
    columns = [*keys, ts_ms, *[c for c in order if c not in (*keys, ts_ms)]]
    rows = stream.select(*columns).withColumn(ts_ms, F.col(ts_ms).cast("bigint"))
    known = F.col(ts_ms).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    limited = _timed(rows.filter(known), F.col(ts_ms), watermark)
    ruled = _ruled(limited, _one_key(limited, keys), ts_ms, order, limit, window_ms, groups).drop("_at")
    none = F.lit(None).cast("bigint")
    free = rows.filter(~known).select(
        *columns, F.lit(True).alias("allowed"), none.alias("count"), none.alias("reset_s"))
    return ruled.unionByName(free)


def stream_quota_scopes(stream: DataFrame, ts_ms: str, order: Sequence[str],
                        limits: Mapping[str, int] = config.QUOTA_LIMITS,
                        window_ms: int = config.QUOTA_WINDOW_SECONDS * 1000, ip_col: str = "ip",
                        user_col: str = "user_id", write_col: str = "event_write",
                        watermark: str = WATERMARK, bystander_groups: int = 64,
                        groups: int = GROUPS) -> DataFrame:
    """The `order` columns and `ts_ms` of every request with `denied_scope` (null if allowed) and the
    remaining quota of every scope that was asked: `operators.quota.quota_scopes`, live.

    One stateful step per scope. Requests that a scope does not concern pass through its step in
    `bystander_groups` groups without state. Requests need an address and a time.
    """
    order = list(order)
    keep_state_on_disk(stream.sparkSession)
    left = _timed(stream.select(
        *[c for c in order if c != ts_ms], F.col(ts_ms).cast("bigint").alias(ts_ms),
        F.col(ip_col).cast("string").alias("_ip"), F.col(user_col).cast("string").alias("_user"),
        F.coalesce(F.col(write_col), F.lit(False)).alias("_write")), F.col(ts_ms), watermark)
    scopes = {
        "ip": (F.col("_ip"), F.lit(True)),
        "user": (F.col("_user"), F.col("_user").isNotNull()),
        "events": (F.coalesce("_user", "_ip"), F.col("_write")),
    }
    left = left.withColumn("denied_scope", F.lit("")).withColumns(
        {f"_{scope}_left": F.lit(-1).cast("bigint") for scope in scopes})
    for scope, (owner, applies) in scopes.items():
        asked = applies & (F.col("denied_scope") == "")
        bystander = F.pmod(F.xxhash64(*order), F.lit(bystander_groups)).cast("string")
        ruled = _ruled(left.withColumn("_asked", asked), F.when(asked, owner).otherwise(bystander),
                       ts_ms, order, limits[scope], window_ms, groups, "_asked")
        denied = F.col("_asked") & ~F.col("allowed")
        left = ruled.withColumns({
            "denied_scope": F.when(denied, scope).otherwise(F.col("denied_scope")),
            f"_{scope}_left": F.when(F.col("_asked"), F.greatest(
                F.lit(0), limits[scope] - F.col("count"))).otherwise(F.col(f"_{scope}_left")),
        }).select(*left.columns)
    return left.select(
        *order, *([ts_ms] if ts_ms not in order else []),
        F.nullif("denied_scope", F.lit("")).alias("denied_scope"),
        *[F.nullif(F.col(f"_{s}_left"), F.lit(-1)).alias(f"{s}_remaining") for s in scopes])


class _Claims(StatefulProcessor):
    def __init__(self, columns: list[str], time: str, order: list[str], ttl_us: int):
        self.columns, self.time, self.order, self.ttl_us = columns, time, order, ttl_us
        self.schema = pa.schema([("key", pa.string()), ("us", pa.int64())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claims = handle.getValueState("claims", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        claims = dict(zip(*_read(self.claims).values()))
        pdf, keys, _, starts = _sorted(rows, self.columns, [self.time, *self.order])
        times = pdf[self.time].to_numpy(np.int64)
        taken = np.ones(len(times), bool)
        for k, lo, hi in zip(keys, starts[:-1].tolist(), starts[1:].tolist()):
            if hi - lo == 1 and k not in claims:
                claims[k] = int(times[lo])
            else:
                taken[lo:hi], claims[k] = claim_times(times[lo:hi], claims.get(k), self.ttl_us)
        live_from = timerValues.getCurrentWatermarkInMs() * 1000 - self.ttl_us
        live = {k: us for k, us in claims.items() if us >= live_from}
        _write(self.claims, self.schema, {"key": list(live), "us": list(live.values())})
        _renew(self.handle, -(-(max([live_from, *live.values()]) + self.ttl_us) // 1000))
        pdf["deduplicated"] = ~taken
        yield pdf.drop(columns=["_key", "_group"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.claims.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_claims(stream: DataFrame, key: str = "event_id", ts_col: str = "arrival_ts",
                  order: Sequence[str] = (), ttl_seconds: int = config.CLAIM_TTL_SECONDS,
                  watermark: str = WATERMARK, groups: int = GROUPS) -> DataFrame:
    """The key, time and `order` columns of every arrival with `deduplicated`, `status` and `mode`, as
    `operators.dedup.ingest_outcome` tells them with `claim_ttl_seconds`.

    A claim ends `ttl_seconds` after the arrival that made it, whatever else arrives. Arrivals without
    an id are never replays.
    """
    keep_state_on_disk(stream.sparkSession)
    extra = [c for c in order if c not in (key, ts_col)]
    rows = stream.select(key, F.unix_micros(F.col(ts_col).cast("timestamp")).alias("_us"), *extra)
    known = F.col(key).isNotNull() & F.col("_us").isNotNull()
    limited = _timed(rows.filter(known), F.floor(F.col("_us") / 1000), watermark)
    grouped = _grouped(limited, _one_key(limited, [key]), groups)
    told = grouped.groupBy("_group").transformWithStateInPandas(
        _Claims(grouped.columns, "_us", extra, ttl_seconds * 1_000_000),
        _with(limited.schema, "deduplicated boolean"), "Append", "EventTime",
        eventTimeColumnName="_at").drop("_at")
    both = told.unionByName(rows.filter(~known).withColumn("deduplicated", F.lit(False)))
    return both.select(
        key, F.timestamp_micros("_us").alias(ts_col), *extra, "deduplicated",
        F.when(F.col("deduplicated"), "deduplicated").otherwise("queued").alias("status"),
        F.lit("async").alias("mode"))
