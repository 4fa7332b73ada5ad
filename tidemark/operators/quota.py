"""Sliding-window quotas over a request log.

A request is allowed if fewer than `limit` requests *that were allowed* lie in the window
`(t - window, t]`; denied requests do not count, so the answer for one request depends on the
answers before it. Computed per key in one pass that would put a whole key into one task.

Instead, with N(t) requests and D(t) denials of a key up to t, and U(t) requests in the window
ending at t:

    D(t) = max(D(just before t), D(t - window) + U(t) - limit)

1. Requests are counted per (key, millisecond) before any shuffle, so a key costs at most one
   row per millisecond however many requests it sends.
2. U(t) is a window sum over (key, time bucket), each bucket with a margin of earlier rows.
3. D can only grow where U(t) > limit. Those points form runs with gaps below the window; runs
   do not influence each other. A key that stays within its limit has none, and its requests are
   answered from U(t) alone.
4. The recurrence is solved run by run while the sorted points stream through tasks. A run with
   more points than one task should see is solved piece after piece: each piece is a step of its
   own that gets the last two windows before it.
"""

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.session import delete_folder, materialize, new_folder

# Python workers get the solver itself and need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A bucket is this many windows long; its margin adds at most 2 / this share of rows.
_WINDOWS_PER_BUCKET = 20
# About as many points of one run as one task solves in a few seconds.
_POINTS_PER_PIECE = 5_000_000


def _per_ms(df: DataFrame, keys: list[str], ts_ms: str) -> DataFrame:
    return (
        df.groupBy(*keys, F.col(ts_ms).cast("bigint").alias("_t"))
        .agg(F.count("*").alias("_n"))
    )


def _bucket(t: Column, bucket_ms: int) -> Column:
    return F.call_function("div", t, F.lit(bucket_ms).cast("bigint"))


def _with_margin(points: DataFrame, bucket_ms: int, margin_ms: int) -> DataFrame:
    """Give every point its time bucket and repeat it as margin of the next bucket if near."""
    own = _bucket(F.col("_t"), bucket_ms)
    near_end = F.pmod(F.col("_t"), F.lit(bucket_ms)) >= bucket_ms - margin_ms
    homes = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return points.withColumn("_bucket", F.explode(homes)).withColumn(
        "_own", own == F.col("_bucket"))


def _limited(keys: list[str], ts_ms: str) -> Column:
    """Requests that have a key and a time; others are not limited."""
    known = F.col(ts_ms).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    return known


def _trailing(keys: list[str], lo: int, hi: int):
    return Window.partitionBy(*keys, "_bucket").orderBy("_t").rangeBetween(lo, hi)


def rolling_count(df: DataFrame, key: str | Sequence[str], ts_ms: str,
                  window_ms: int = config.QUOTA_WINDOW_SECONDS * 1000,
                  name: str = "rolling") -> DataFrame:
    """Requests of the same key in `(t - window, t]`, for every request."""
    keys = [key] if isinstance(key, str) else list(key)
    points = _with_margin(_per_ms(df, keys, ts_ms), window_ms * _WINDOWS_PER_BUCKET, window_ms)
    rolled = points.withColumn(
        name, F.sum("_n").over(_trailing(keys, -(window_ms - 1), 0))
    ).filter("_own").select(*keys, F.col("_t").alias(ts_ms), name)
    return df.join(rolled, [*keys, ts_ms], "left")


def _denials(t: np.ndarray, excess: np.ndarray, window_ms: int,
             past_t: np.ndarray, past_d: np.ndarray) -> np.ndarray:
    """Cumulative denials at the points `t` of one run, given the points before them.

    Inside a stretch shorter than the window, D(t - window) refers to points before the stretch,
    so a stretch is one vector operation.
    """
    all_t = np.concatenate([past_t, t])
    all_d = np.concatenate([past_d, np.zeros(len(t), dtype=np.int64)])
    done = len(past_t)
    level = all_d[done - 1] if done else 0
    while done < len(all_t):
        stop = np.searchsorted(all_t, all_t[done] + window_ms, side="left")
        ref = np.searchsorted(all_t, all_t[done:stop] - window_ms, side="right") - 1
        base = np.where(ref >= 0, all_d[np.maximum(ref, 0)], 0)
        d = np.maximum.accumulate(
            np.maximum(base + excess[done - len(past_t):stop - len(past_t)], level))
        all_d[done:stop] = d
        level = d[-1]
        done = stop
    return all_d[len(past_t):]


def _solver(run_columns: list[str], window_ms: int):
    """Solve runs that stream by, sorted by run and time.

    Rows that bring `_d` are already solved and only set the state. Memory holds one Arrow batch
    and the last two windows of one run.
    """
    none = np.empty(0, dtype=np.int64)

    def starts_of(pdf: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(pdf), dtype=bool)
        for c in run_columns:
            now, before = pdf[c], pdf[c].shift()
            change |= ((now != before) & ~(now.isna() & before.isna())).to_numpy()
        change[0] = True
        return np.flatnonzero(change)

    def identity(pdf: pd.DataFrame, i: int) -> tuple:
        return tuple(None if pd.isna(v) else v for v in pdf[run_columns].iloc[i])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, past_t, past_d = None, none, none
        for pdf in batches:
            if pdf.empty:
                continue
            pdf = pdf.reset_index(drop=True)
            t = pdf["_t"].to_numpy(np.int64)
            excess = pdf["_excess"].to_numpy(np.int64)
            known = pdf["_d"].notna().to_numpy()
            d = pdf["_d"].fillna(0).to_numpy(np.int64).copy()
            before = np.zeros(len(pdf), dtype=np.int64)
            starts = starts_of(pdf)
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                if lo > 0 or identity(pdf, 0) != run:
                    past_t, past_d = none, none
                solved = lo + int(known[lo:hi].sum())
                if solved > lo:
                    past_t = np.concatenate([past_t, t[lo:solved]])
                    past_d = np.concatenate([past_d, d[lo:solved]])
                if solved < hi:
                    d[solved:hi] = _denials(t[solved:hi], excess[solved:hi], window_ms,
                                            past_t, past_d)
                    before[solved:hi] = np.concatenate([past_d[-1:] if len(past_d) else [0],
                                                        d[solved:hi - 1]])
                if hi == len(pdf):
                    past_t = np.concatenate([past_t, t[solved:hi]])
                    past_d = np.concatenate([past_d, d[solved:hi]])
                    recent = past_t > t[hi - 1] - 2 * window_ms
                    past_t, past_d = past_t[recent], past_d[recent]
            run = identity(pdf, len(pdf) - 1)
            pdf["_d"], pdf["_denied"] = d, d - before
            yield pdf[~known]
    return solve


def _runs(over: DataFrame, keys: list[str], window_ms: int, bucket_ms: int) -> DataFrame:
    """Give each point over the limit the start of its run, `_run`.

    A run starts at a point with no other one in the window before it. Inside a bucket the start
    is a running maximum; across buckets the maximum per bucket is carried on, one row per bucket
    and key.
    """
    near = _with_margin(over, bucket_ms, window_ms)
    previous = F.max("_t").over(_trailing(keys, -(window_ms - 1), -1))
    starts = near.withColumn("_start", F.when(previous.isNull(), F.col("_t"))).filter("_own")
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy("_t")
    starts = starts.withColumn("_run", F.max("_start").over(in_bucket))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = (
        starts.groupBy(*keys, "_bucket").agg(F.max("_start").alias("_last"))
        .withColumn("_carried", F.max("_last").over(earlier))
        .select(*keys, "_bucket", "_carried")
    )
    return starts.join(carried, [*keys, "_bucket"]).select(
        *keys, "_t", "_excess", F.coalesce("_run", "_carried").alias("_run"))


def _solve_runs(runs: DataFrame, keys: list[str], window_ms: int,
                points_per_piece: int) -> DataFrame:
    # Written once: the measurement and every piece below read it again.
    runs = materialize(runs.withColumn("_d", F.lit(None).cast("bigint")))
    by = [*keys, "_run"]
    out_schema = runs.withColumn("_denied", F.col("_d")).schema
    solve = _solver(by, window_ms)

    def solved(rows: DataFrame) -> DataFrame:
        return rows.repartition(*by).sortWithinPartitions(*by, "_t").mapInPandas(
            solve, out_schema)

    largest = runs.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= points_per_piece:
        return solved(runs)

    # Slices are gathered into pieces by their points, and every piece is written to a folder of its
    # own, so that a step reads no more than it solves. A millisecond is one point, so no slice has
    # more points than a piece, and the pieces of a run are numbered without gaps.
    spark = runs.sparkSession
    slice_ms = min(window_ms, points_per_piece)
    slices = runs.withColumn("_slice", F.floor((F.col("_t") - F.col("_run")) / slice_ms))
    counts = slices.groupBy(*by, "_slice").agg(F.count("*").alias("_points"))
    before = F.sum("_points").over(Window.partitionBy(*by).orderBy("_slice")) - F.col("_points")
    pieces = materialize(counts.withColumn(
        "_piece", F.floor(before / points_per_piece).cast("int")).drop("_points"))
    starts = pieces.groupBy(*by, "_piece").agg(
        (F.min("_slice") * slice_ms + F.col("_run") - 2 * window_ms).alias("_since"))
    folder = new_folder(spark)
    same = [slices[c].eqNullSafe(pieces[c]) for c in [*by, "_slice"]]
    slices.join(pieces, same).select(*[slices[c] for c in runs.columns], "_piece").write.partitionBy(
        "_piece").parquet(f"{folder}/in")

    def recent(rows: DataFrame, n: int) -> DataFrame:
        """The last two windows before piece `n` of each run that goes on."""
        return rows.join(starts.filter(F.col("_piece") == n), by).filter(
            F.col("_t") >= F.col("_since")).select(*runs.columns)

    past = None
    steps = pieces.agg(F.max("_piece")).first()[0] + 1
    for n in range(steps):
        rows = spark.read.schema(runs.schema).parquet(f"{folder}/in/_piece={n}")
        done = f"{folder}/out/step={n}"
        solved(rows if past is None else rows.unionByName(past)).write.parquet(done)
        latest = spark.read.schema(out_schema).parquet(done).drop("_denied")
        past = materialize(recent(latest if past is None else latest.unionByName(past), n + 1))
    delete_folder(spark, f"{folder}/in")
    return spark.read.schema(out_schema).parquet(*[f"{folder}/out/step={n}" for n in range(steps)])


def _after_denials(points: DataFrame, denied: DataFrame, keys: list[str], window_ms: int,
                   bucket_ms: int) -> DataFrame:
    """Allowed requests per point, allowed ones before it in its window, and the oldest of them.

    Only buckets that a denial can reach are worked out; elsewhere everything in the window was
    allowed and U(t) already says it.
    """
    last_reached = F.col("_t") + F.lit(window_ms - 1)
    reached = denied.withColumn("_bucket", F.explode(F.array_distinct(F.array(
        _bucket(F.col("_t"), bucket_ms), _bucket(last_reached, bucket_ms)
    )))).select(*keys, "_bucket").distinct()

    near = _with_margin(points, bucket_ms, window_ms).join(
        reached, [*keys, "_bucket"], "left_semi")
    granted = near.join(denied, [*keys, "_t"], "left").withColumn(
        "_ok", F.col("_n") - F.coalesce("_denied", F.lit(0)))
    worked_out = granted.withColumns({
        "_before": F.coalesce(F.sum("_ok").over(_trailing(keys, -(window_ms - 1), -1)),
                              F.lit(0)),
        "_oldest": F.min(F.when(F.col("_ok") > 0, F.col("_t")))
        .over(_trailing(keys, -(window_ms - 1), 0)),
    }).filter("_own").select(*keys, "_t", "_n", "_ok", "_before", "_oldest")

    calm = points.withColumn("_bucket", _bucket(F.col("_t"), bucket_ms)).join(
        reached, [*keys, "_bucket"], "left_anti")
    return worked_out.unionByName(calm.select(
        *keys, "_t", "_n", F.col("_n").alias("_ok"), (F.col("_u") - F.col("_n")).alias("_before"),
        F.lit(None).cast("bigint").alias("_oldest")))


def sliding_quota(df: DataFrame, key: str | Sequence[str], ts_ms: str, limit: int,
                  window_ms: int = config.QUOTA_WINDOW_SECONDS * 1000,
                  order: Sequence[str] = (), points_per_piece: int = _POINTS_PER_PIECE,
                  ) -> DataFrame:
    """Append `allowed`, `count` (allowed in the window, this one included) and `reset_s`.

    `order` tells requests of one key and millisecond apart and fixes who is served first.
    Requests without a key or a time are not limited and have no count.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = list(order)
    if not order:
        raise ValueError("order must name columns that identify a request")
    bucket_ms = window_ms * _WINDOWS_PER_BUCKET

    limited = df.filter(_limited(keys, ts_ms))
    counted = _with_margin(_per_ms(limited, keys, ts_ms), bucket_ms, window_ms).withColumn(
        "_u", F.sum("_n").over(_trailing(keys, -(window_ms - 1), 0)))
    # Written once: the runs and the state of every point start from it.
    points = materialize(counted.filter("_own").select(*keys, "_t", "_n", "_u"))
    over = points.filter(F.col("_u") > limit).select(
        *keys, "_t", (F.col("_u") - F.lit(limit)).alias("_excess"))
    denied = _solve_runs(_runs(over, keys, window_ms, bucket_ms), keys, window_ms,
                         points_per_piece)
    denied = materialize(denied.filter("_denied > 0").select(*keys, "_t", "_denied"))
    state = _after_denials(points, denied, keys, window_ms, bucket_ms).withColumnRenamed(
        "_t", ts_ms)
    if points.filter(F.col("_n") > limit).isEmpty():
        served = _place(limited, state, keys, ts_ms, order)
    else:
        served = _place_crowded(limited, materialize(state), keys, ts_ms, limit, order)
    free = df.filter(~_limited(keys, ts_ms)).withColumns({
        "allowed": F.lit(True), "count": F.lit(None).cast("bigint"),
        "reset_s": F.lit(None).cast("bigint")})
    return _answer(served, ts_ms, limit, window_ms).select(free.columns).unionByName(free)


def _place(df: DataFrame, state: DataFrame, keys: list[str], ts_ms: str,
           order: list[str]) -> DataFrame:
    """Requests with the state of their millisecond and their place in it."""
    place = F.row_number().over(Window.partitionBy(*keys, ts_ms).orderBy(*order))
    return df.join(state, [*keys, ts_ms]).withColumn("_place", place)


def _place_crowded(df: DataFrame, state: DataFrame, keys: list[str], ts_ms: str, limit: int,
                   order: list[str]) -> DataFrame:
    """The same where some millisecond has more than `limit` requests of one key.

    There only the first `limit` can be served; they are found by a ranked filter, which Spark
    reduces before the shuffle, and all others need no place.
    """
    calm = _place(df, state.filter(F.col("_n") <= limit), keys, ts_ms, order)
    crowd = state.filter(F.col("_n") > limit)
    first = _place(df, crowd, keys, ts_ms, order).filter(F.col("_place") <= limit)
    placed = first.select(*keys, ts_ms, *order, "_place")
    # Not an anti join, which the optimizer would move below the join with the crowd.
    rest = df.join(crowd, [*keys, ts_ms]).join(
        placed, [*keys, ts_ms, *order], "left").filter(F.col("_place").isNull())
    return calm.unionByName(first).unionByName(rest)


def _answer(served: DataFrame, ts_ms: str, limit: int, window_ms: int) -> DataFrame:
    allowed = F.coalesce(F.col("_place") <= F.col("_ok"), F.lit(False))
    wait_ms = F.greatest(
        F.lit(0), F.coalesce(F.col("_oldest") + window_ms - F.col(ts_ms), F.lit(window_ms)))
    return served.withColumns({
        "allowed": allowed,
        "count": F.when(allowed, F.col("_before") + F.col("_place"))
        .otherwise(F.lit(limit).cast("bigint")),
        "reset_s": F.ceil(F.when(allowed, F.lit(window_ms)).otherwise(wait_ms) / 1000),
    })


def quota_scopes(df: DataFrame, ts_ms: str, order: Sequence[str],
                 limits: Mapping[str, int] = config.QUOTA_LIMITS,
                 window_ms: int = config.QUOTA_WINDOW_SECONDS * 1000, ip_col: str = "ip",
                 user_col: str = "user_id", write_col: str = "event_write") -> DataFrame:
    """Check the ip, user and event-write quotas one after the other.

    A request that one scope denies is not seen by the later scopes and is not refunded in the
    earlier ones. Anonymous requests skip the user scope, reads skip the events scope. Appends
    `denied_scope` (NULL if allowed) and the remaining quota of every scope that was asked.
    """
    scopes = {
        "ip": (F.col(ip_col).cast("string"), F.lit(True)),
        "user": (F.col(user_col).cast("string"), F.col(user_col).isNotNull()),
        "events": (F.coalesce(F.col(user_col).cast("string"), F.col(ip_col).cast("string")),
                   F.col(write_col)),
    }
    left, settled = df, None
    for scope in scopes:
        left = left.withColumn(f"{scope}_remaining", F.lit(None).cast("bigint"))
    left = left.withColumn("denied_scope", F.lit(None).cast("string"))
    for scope, (owner, applies) in scopes.items():
        applies = F.coalesce(applies, F.lit(False))
        ruled = sliding_quota(left.filter(applies).withColumn("_owner", owner), "_owner", ts_ms,
                              limits[scope], window_ms, order)
        ruled = materialize(
            ruled.withColumns({
                f"{scope}_remaining": F.greatest(F.lit(0), limits[scope] - F.col("count")),
                "denied_scope": F.when(~F.col("allowed"), scope),
            }).select(*left.columns)
        )
        denied = ruled.filter(F.col("denied_scope").isNotNull())
        settled = denied if settled is None else settled.unionByName(denied)
        left = ruled.filter(F.col("denied_scope").isNull()).unionByName(left.filter(~applies))
    return settled.unionByName(left)
