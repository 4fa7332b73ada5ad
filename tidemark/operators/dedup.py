"""First-arrival dedup, stored-id checks, ingest outcomes, upserts, versioned updates.

Nothing here sends all rows of one key to one task (but for the distinct times of an id that is
replayed beyond its claim): winners are found by an aggregate or a
ranked filter that Spark reduces before the shuffle, and are matched back to the rows on the
key together with the arrival order, which spreads a hot key.
"""

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import scalars as S

# Python workers get the functions themselves and need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def dedup_first(df: DataFrame, key: str = "event_id",
                order: str | Sequence[str] = "arrival_ts") -> DataFrame:
    """Keep the first arrival per key. Rows without a key are no replays of each other and pass.

    The rank filter is applied on both sides of the shuffle (window group limit), so a key that
    is replayed without end costs one row per map task.
    """
    return first_by(df, [key], [F.col(c) for c in _list(order)])


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in an order; each row with a NULL in the key is its own key."""
    loose = F.lit(False)
    for k in keys:
        loose = loose | F.col(k).isNull()
    alone = df.withColumn("_alone", F.when(loose, F.monotonically_increasing_id()))
    by_order = Window.partitionBy(*keys, "_alone").orderBy(*order)
    return alone.withColumn("_n", F.row_number().over(by_order)).filter("_n = 1").drop(
        "_n", "_alone")


def stored_keys(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The incoming keys that `target` already holds.

    The history is only probed: a small batch of ids is broadcast to it (AQE checks the size),
    a large one is joined by shuffle.
    """
    probe = incoming.select(key).filter(F.col(key).isNotNull()).distinct()
    return target.select(key).join(probe, key, "left_semi")


def _without(rows: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among `hits`.

    Not an anti join: the optimizer moves that below an aggregate, where it meets every copy of
    a hot key instead of one row of it.
    """
    flagged = hits.withColumn("_stored", F.lit(True))
    return rows.join(flagged, key, "left").filter(F.col("_stored").isNull()).drop("_stored")


def new_events_only(incoming: DataFrame, target: DataFrame, key: str = "event_id") -> DataFrame:
    """Drop incoming rows whose key is already stored."""
    return _without(incoming, stored_keys(target, incoming, key), key)


def first_new_events(incoming: DataFrame, target: DataFrame, key: str = "event_id",
                     order: str | Sequence[str] = "arrival_ts") -> DataFrame:
    """First arrival per key of those that are not stored."""
    return _without(dedup_first(incoming, key, order), stored_keys(target, incoming, key), key)


def insert_if_absent(target: DataFrame, rows: DataFrame, key: str | Sequence[str],
                     order: str | Sequence[str] | None = None) -> DataFrame:
    """`target` plus those rows whose natural key it does not hold yet.

    Of rows that share a key the first in `order` is inserted, by default the one with the
    smallest other values.
    """
    keys = _list(key)
    order = _list(order) if order else [c for c in rows.columns if c not in keys] or keys
    fresh = first_by(rows, keys, [F.col(c) for c in order])
    return target.unionByName(fresh.join(target.select(*keys), keys, "left_anti"))


def ingest_outcome(incoming: DataFrame, target: DataFrame, mode: str = "async",
                   key: str = "event_id", order: str | Sequence[str] = "arrival_ts",
                   claim_ttl_seconds: int | None = None) -> DataFrame:
    """Tell for every arrival whether it was taken or is a replay.

    The first arrival of an id that is not stored is `accepted` (sync) or `queued` (async),
    all others are `deduplicated`. `order` must be unique per key. Arrivals without an id are
    never replays.

    With `claim_ttl_seconds`, an async claim is forgotten after that time, so a later replay
    is queued again (and stopped by the stored-id check when it is written). `order` is then a
    single timestamp column.
    """
    taken = "accepted" if mode == "sync" else "queued"
    order = _list(order)
    if claim_ttl_seconds is not None and mode != "sync":
        first = claims(incoming, key, order[0], claim_ttl_seconds).withColumn(
            "_taken", F.lit(True))
    else:
        if len(order) == 1:
            first = incoming.groupBy(key).agg(F.min(order[0]).alias(order[0]))
        else:
            first = incoming.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
            first = first.select(key, "_first.*")
        first = _without(first, stored_keys(target, incoming, key), key).withColumn(
            "_taken", F.lit(True))
    out = incoming.join(first, [key, *order], "left").withColumn(
        "deduplicated", F.col("_taken").isNull() & F.col(key).isNotNull()).drop("_taken")
    return out.withColumns({
        "status": F.when(F.col("deduplicated"), "deduplicated").otherwise(taken),
        "mode": F.lit(mode),
    })


def claim_times(times: np.ndarray, claim: int | None, ttl: int) -> tuple[np.ndarray, int | None]:
    """Which of the rising `times` claim their key: the first one, and each first one after the claim
    before it has run out. `claim` is the claim so far; the last claim comes back too."""
    taken = np.zeros(len(times), bool)
    i = 0 if claim is None else int(np.searchsorted(times, claim + ttl))
    while i < len(times):
        taken[i], claim = True, int(times[i])
        i = int(np.searchsorted(times, claim + ttl))
    return taken, claim


def _followed(ttl_us: int):
    """The claims among (key, time in microseconds) that stream by, sorted; memory holds one batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = claim = None
        for pdf in batches:
            if pdf.empty:
                continue
            keys, times = pdf.iloc[:, 0], pdf.iloc[:, 1].to_numpy(np.int64)
            starts = np.flatnonzero((keys != keys.shift()).to_numpy())
            taken = np.zeros(len(pdf), bool)
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                if lo > 0 or keys.iloc[0] != key:
                    claim = None
                taken[lo:hi], claim = claim_times(times[lo:hi], claim, ttl_us)
            key = keys.iloc[-1]
            yield pdf[taken]
    return run


def claims(arrivals: DataFrame, key: str, ts: str, ttl_seconds: int) -> DataFrame:
    """(key, time) of the arrivals that claim their key: the first one, and every first one after
    the claim before it has run out.

    The first claims come from one aggregate. Only keys that arrive again after the claim time are
    followed further, in one sorted pass over their distinct arrival times, which skips from claim
    to claim. A key's times stream through one task; its repeated ones are gone before.
    """
    ttl = F.make_dt_interval(secs=F.lit(ttl_seconds))
    kind = arrivals.schema[ts].dataType
    known = arrivals.select(key, ts).filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    spans = known.groupBy(key).agg(F.min(ts).alias("_at"), F.max(ts).alias("_last"))
    again = F.col("_last") >= F.col("_at") + ttl
    parts = int(arrivals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    times = (
        known.join(spans.filter(again).select(key), key, "left_semi")
        .select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")).distinct()
        .repartition(parts, key).sortWithinPartitions(key, "_us")
    )
    followed = times.mapInPandas(_followed(ttl_seconds * 1_000_000), times.schema).select(
        key, F.timestamp_micros("_us").cast(kind).alias(ts))
    return spans.filter(~again).select(key, F.col("_at").alias(ts)).unionByName(followed)


def batch_outcome(outcomes: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Accepted (queued ones included) and deduplicated counts per batch."""
    return outcomes.groupBy(*_list(by)).agg(
        F.count_if(~F.col("deduplicated")).alias("accepted"),
        F.count_if(F.col("deduplicated")).alias("deduplicated"),
    )


def expire_keys(df: DataFrame, as_of, hours: int = config.EXPIRED_KEY_GRACE_HOURS,
                expires_col: str = "expires_at") -> tuple[DataFrame, DataFrame]:
    """Split into kept keys and keys that expired more than `hours` ago."""
    gone = F.col(expires_col) < S.before(as_of, hours, "hours")
    return df.filter(~gone | F.col(expires_col).isNull()), df.filter(gone)


def upsert(existing: DataFrame, updates: DataFrame, keys: str | Sequence[str],
           newest: str = "computed_at") -> DataFrame:
    """Insert or replace by unique key. Of several updates of a key the newest wins, by the column
    `newest` if there is one and then by the largest other values."""
    keys = _list(keys)
    rest = [c for c in updates.columns if c not in keys and c != newest]
    by = [F.col(c).desc_nulls_last() for c in [newest, *rest] if c in updates.columns]
    updates = first_by(updates, keys, by or [F.col(k) for k in keys])
    return existing.join(updates.select(*keys), keys, "left_anti").unionByName(updates)


def versioned_update(target: DataFrame, changes: DataFrame, roles: DataFrame, key: str = "id",
                     order: str = "arrival", values: Sequence[str] = ("full_name", "is_active"),
                     ) -> tuple[DataFrame, DataFrame]:
    """Compare-and-set by version. Returns the new target and one outcome per change.

    A change is applied if its `version` is the stored one; it bumps the version and a NULL
    field leaves the stored value. Changes are judged against the version stored before the
    batch; of several that match, the first arrival wins and the rest conflict.
    """
    known = changes.join(
        target.select(key, F.col("version").alias("_stored")), key, "left"
    ).join(
        roles.select(F.col("name").alias("role"), F.col("id").alias("_role_id")), "role", "left"
    )
    judged = known.withColumn(
        "_fault",
        F.when(F.col("_stored").isNull(), "not_found")
        .when(F.col("role").isNotNull() & ~F.col("role").isin(*config.ROLE_NAMES), "conflict")
        .when(F.col("role").isNotNull() & F.col("_role_id").isNull(), "not_found")
        .when(F.col("version") != F.col("_stored"), "version_conflict"),
    )
    winners = (
        judged.filter(F.col("_fault").isNull())
        .groupBy(key)
        .agg(F.min_by(F.struct(order, "_role_id", *values), F.col(order)).alias("_change"))
        .select(key, "_change.*")
    )
    outcomes = judged.join(
        winners.select(key, order, F.lit(True).alias("_won")), [key, order], "left"
    ).select(
        key, order, changes["version"],
        F.coalesce("_fault", F.when(F.col("_won"), "applied"),
                   F.lit("version_conflict")).alias("outcome"),
    )
    renamed = winners.select(
        key, F.lit(True).alias("_hit"), F.col("_role_id").alias("_new_role_id"),
        *[F.col(v).alias(f"_new_{v}") for v in values],
    )

    def merged(name: str) -> Column:
        if name == "version":
            return F.col(name) + F.when(F.col("_hit"), 1).otherwise(0)
        if name in values or name == "role_id":
            return F.coalesce(f"_new_{name}", name)
        return F.col(name)

    new_target = target.join(renamed, key, "left").select(
        *[merged(c).cast(t.dataType).alias(c) for c, t in zip(target.columns, target.schema)])
    return new_target, outcomes
