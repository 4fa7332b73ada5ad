"""Request-log and outcome statistics.

`access_log(ts, method, path, status, duration_s, ip, user_id)`
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import scalars as S
from tidemark.session import materialize


def request_counts(access_log: DataFrame) -> DataFrame:
    return access_log.groupBy(
        "method", S.normalize_path("path").alias("path"), F.col("status").cast("string")
        .alias("status")
    ).agg(F.count("*").alias("requests"))


def _bucket_columns(buckets: Sequence[float], value: Column) -> list[Column]:
    return [F.count_if(value <= F.lit(float(b))).alias(f"_le{i}") for i, b in enumerate(buckets)]


def latency_histogram(access_log: DataFrame, by: Sequence[Column | str] | None = None,
                      buckets: Sequence[float] = config.LATENCY_BUCKETS,
                      value_col: str = "duration_s") -> DataFrame:
    """Cumulative buckets `le` (text, `+Inf` last) with the group's count and sum.

    All buckets are counted in one aggregate and spread into rows after it, so no log row is
    multiplied. The sum is exact to the microsecond.
    """
    if by is None:
        by = ["method", S.normalize_path("path").alias("path")]
    value = F.col(value_col)
    grouped = access_log.groupBy(*by).agg(
        *_bucket_columns(buckets, value),
        F.count("*").alias("count"),
        F.sum(value.cast("decimal(18,6)")).cast("double").alias("sum_s"),
    )
    rows = F.array(
        *[F.struct(F.lit(i).alias("bucket"), F.lit(str(float(b))).alias("le"),
                   F.col(f"_le{i}").alias("le_count")) for i, b in enumerate(buckets)],
        F.struct(F.lit(len(buckets)).alias("bucket"), F.lit("+Inf").alias("le"),
                 F.col("count").alias("le_count")),
    )
    keys = [c for c in grouped.columns if not c.startswith("_le") and c not in ("count", "sum_s")]
    return grouped.select(*keys, F.inline(rows), "count", "sum_s")


def histogram_quantile(histogram: DataFrame, q: float = 0.95, by: Sequence[str] = (),
                       buckets: Sequence[float] = config.LATENCY_BUCKETS) -> DataFrame:
    """Quantile from cumulative buckets: linear inside a bucket, from 0 in the first one, and
    the highest finite bound if it lies beyond."""
    merged = histogram.groupBy(*by, "bucket").agg(F.sum("le_count").alias("c"))
    cells = merged.groupBy(*by).agg(*[
        F.max(F.when(F.col("bucket") == i, F.col("c"))).cast("double").alias(f"_c{i}")
        for i in range(len(buckets) + 1)
    ])
    bounds = [float(b) for b in buckets]
    rank = F.lit(float(q)) * F.col(f"_c{len(bounds)}")
    out = None
    for i, upper in enumerate(bounds):
        lower = bounds[i - 1] if i else 0.0
        below = F.col(f"_c{i - 1}") if i else F.lit(0.0)
        inside = F.lit(lower) + F.lit(upper - lower) * (rank - below) / (F.col(f"_c{i}") - below)
        hit = F.col(f"_c{i}") >= rank
        out = F.when(hit, inside) if out is None else out.when(hit, inside)
    total = F.col(f"_c{len(bounds)}")
    return cells.select(*by, F.when(total > 0, out.otherwise(F.lit(bounds[-1])))
                        .alias("quantile"))


def latency_p95(access_log: DataFrame, window: str = "5 minutes", q: float = 0.95) -> DataFrame:
    """Latency quantile over all requests per time window, from the buckets."""
    log = access_log.withColumn("window_start", F.window("ts", window).start)
    return histogram_quantile(latency_histogram(log, by=["window_start"]), q,
                              by=["window_start"])


def request_rate(access_log: DataFrame, window: str = "1 minute", seconds: int = 60,
                 by: Sequence[str] = (), ts_col: str = "ts") -> DataFrame:
    """Rows per second in fixed time windows."""
    return access_log.groupBy(F.window(ts_col, window).start.alias("window_start"), *by).agg(
        F.count("*").alias("n")).select(
        "window_start", *by, "n", (F.col("n") / F.lit(float(seconds))).alias("per_second"))


def ingest_rate_by_result(outcomes: DataFrame) -> DataFrame:
    """Ingest outcomes per mode and result; queued ones count as accepted."""
    result = F.when(F.col("deduplicated"), "deduplicated").otherwise("accepted")
    return outcomes.groupBy("mode", result.alias("result")).agg(F.count("*").alias("n"))


def ingest_rate(outcomes: DataFrame, ts_col: str, window: str = "1 minute") -> DataFrame:
    """Ingest outcomes per second and result in fixed time windows."""
    result = F.when(F.col("deduplicated"), "deduplicated").otherwise("accepted")
    return request_rate(outcomes.withColumn("result", result), window, by=["result"],
                        ts_col=ts_col)


def writes_by_result(outcomes: DataFrame) -> DataFrame:
    result = F.when(F.col("deduplicated"), "conflict").otherwise("inserted")
    return outcomes.groupBy(result.alias("result")).agg(F.count("*").alias("n"))


def dlq_by_reason(dlq: DataFrame) -> DataFrame:
    """Dead letters by reason; all exceptions share one label."""
    return dlq.groupBy(F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason")).agg(
        F.count("*").alias("n"))


def quota_hits_by_scope(ruled: DataFrame) -> DataFrame:
    return ruled.filter(F.col("denied_scope").isNotNull()).groupBy(
        F.col("denied_scope").alias("scope")).agg(F.count("*").alias("n"))


def read_source_ratio(reads: DataFrame, source_col: str = "source") -> DataFrame:
    """Cache operations behind a set of reads: every read gets, every miss that was computed or
    refilled sets."""
    counts = reads.agg(
        F.count_if(F.col(source_col) == "cache").alias("hit"),
        F.count_if(F.col(source_col) != "cache").alias("miss"),
        F.count_if(F.col("refilled")).alias("ok"),
    )
    return counts.select(F.inline(F.array(
        F.struct(F.lit("get").alias("op"), F.lit("hit").alias("result"), F.col("hit").alias("n")),
        F.struct(F.lit("get").alias("op"), F.lit("miss").alias("result"),
                 F.col("miss").alias("n")),
        F.struct(F.lit("set").alias("op"), F.lit("ok").alias("result"), F.col("ok").alias("n")),
    )))


def queue_gauges(stats: DataFrame) -> DataFrame:
    """Gauge values from queue statistics."""
    return stats.select(F.inline(F.array(
        F.struct(F.lit("event_stream_lag").alias("gauge"), F.col("pending").alias("value")),
        F.struct(F.lit("event_stream_dlq_size").alias("gauge"),
                 F.col("dlq_length").alias("value")),
    )))


# -- exact percentiles -------------------------------------------------------------------------

#: Slots with more rows are cut further before their values are ranked.
_SLOT_ROWS = 1_000_000


def exact_percentiles(df: DataFrame, value_col: str, quantiles: dict[str, float],
                      by: Sequence[str] = (), resolution: float = 0.01) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per entry of `quantiles`.

    Holding all values of a group in one aggregate does not scale. A first pass counts rows per
    slot of width `resolution` and finds the slots that hold a wanted rank, at most two per
    quantile and group. While such a slot holds more than `_SLOT_ROWS` rows of different values,
    its rows are counted again in slots a thousandth as wide. A last pass reads only the rows of
    the slots found and ranks their distinct values. The tables of slots are written, so that
    their real size decides whether a later pass can broadcast them.
    """
    by = list(by)
    rows = df.select(*by, F.col(value_col).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull())

    def position(q: float) -> Column:
        return F.lit(float(q)) * (F.col("_total") - 1)

    def inside(rank: Column, lo: Column, hi: Column) -> Column:
        return (rank >= lo) & (rank < hi)

    ranks = [(name, part, fn(position(q))) for name, q in quantiles.items()
             for part, fn in (("lo", F.floor), ("hi", F.ceil))]
    wanted = F.lit(False)
    for _, _, r in ranks:
        wanted = wanted | inside(r, F.col("_begin"), F.col("_end"))

    def found(within: DataFrame, parents: list[str]) -> DataFrame:
        """The slots with a wanted rank. `_begin` counts the rows of the group below a slot."""
        parent = Window.partitionBy(*by, *parents)
        base = F.col("_base") if parents else F.lit(0)
        total = F.col("_all") if parents else F.sum("_rows").over(parent)
        kept = [*parents, "_base", "_all"] if parents else []
        counts = within.groupBy(*by, *kept, "_slot").agg(
            F.count("*").alias("_rows"), (F.min("_v") < F.max("_v")).alias("_differ"))
        return materialize(counts.withColumns({
            "_end": base + F.sum("_rows").over(parent.orderBy("_slot")), "_total": total,
        }).withColumn("_begin", F.col("_end") - F.col("_rows")).filter(wanted).select(
            *[F.col(c).alias(f"_at_{c}") for c in [*by, "_slot"]], "_begin", "_total", "_rows",
            "_differ"))

    def hits(marked: DataFrame, width: float) -> DataFrame:
        """The rows of the slots."""
        slotted = rows.withColumn("_slot", F.floor(F.col("_v") / F.lit(width)))
        same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in [*by, "_slot"]]
        return slotted.join(marked.drop("_rows", "_differ"), same).select(*slotted.columns,
                                                                         "_begin", "_total")

    width = resolution
    marked = found(rows.withColumn("_slot", F.floor(F.col("_v") / F.lit(width))), [])
    while width > resolution * 1e-9 and marked.filter(
            F.col("_differ") & (F.col("_rows") > _SLOT_ROWS)).limit(1).count():
        inner = hits(marked, width).withColumnsRenamed(
            {"_slot": "_parent", "_begin": "_base", "_total": "_all"})
        width /= 1024
        marked = found(inner.withColumn("_slot", F.floor(F.col("_v") / F.lit(width))), ["_parent"])
    counted = hits(marked, width).groupBy(
        *by, "_slot", "_begin", "_total", "_v").agg(F.count("*").alias("_k"))
    ranked = counted.withColumn("_to", F.col("_begin") + F.sum("_k").over(
        Window.partitionBy(*by, "_slot").orderBy("_v")))
    picked = ranked.groupBy(*by).agg(
        F.max("_total").alias("_total"),
        *[F.max(F.when(inside(r, F.col("_to") - F.col("_k"), F.col("_to")), F.col("_v")))
          .alias(f"_{name}_{part}") for name, part, r in ranks])
    return picked.select(*by, *[
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))
         * (position(q) - F.floor(position(q)))).alias(n)
        for n, q in quantiles.items()
    ])


def _report(access_log: DataFrame, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Requests, failures, mean, percentiles in ms and rate per group."""
    log = access_log.withColumn("ms", F.col("duration_s") * 1000.0)
    counts = log.groupBy(*by).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") >= 500).alias("failures"),
        (F.sum(F.col("ms").cast("decimal(24,6)")).cast("double") / F.count("*"))
        .alias("mean_ms"),
        F.min("ts").alias("_from"), F.max("ts").alias("_to"),
    )
    # The span of the whole log; the aggregate under it is that of the groups.
    first, last = counts.agg(F.min("_from")).scalar(), counts.agg(F.max("_to")).scalar()
    span = F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    counts = counts.withColumn("_s", span / F.lit(1e6)).drop("_from", "_to")
    marks = exact_percentiles(log, "ms", quantiles, by, resolution=1.0)
    rate = F.when(F.col("_s") > 0, F.col("requests") / F.col("_s"))
    return counts.join(marks, by, "left").withColumn("rps", rate).drop("_s")


def endpoint_report(access_log: DataFrame) -> DataFrame:
    """Requests, failures, median, p95 and rate per method and normalised path."""
    log = access_log.withColumn(
        "name", F.concat("method", F.lit(" "), S.normalize_path("path")))
    return _report(log, ["name"], {"median_ms": 0.5, "p95_ms": 0.95}).select(
        "name", "requests", "failures", "median_ms", "p95_ms", "rps")


def error_rate(failures: Column, requests: Column) -> Column:
    """Share of failures as text with three decimals, `0%` when nothing was asked."""
    return F.when(requests == 0, "0%").otherwise(
        F.format_string("%.3f%%", failures / requests * 100))


def aggregate_report(access_log: DataFrame) -> DataFrame:
    """The same over all requests, one row, with the error rate."""
    quantiles = {"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    log = access_log.withColumn("name", F.lit("Aggregated"))
    return _report(log, ["name"], quantiles).select(
        "requests", "failures", error_rate(F.col("failures"), F.col("requests"))
        .alias("error_rate"), "median_ms", "mean_ms", "p95_ms", "p99_ms", "rps")


def aggregate_row(load_stats: DataFrame, row_order: str) -> DataFrame:
    """The totals row of a load-run file: the first one named so, else the last row."""
    is_total = F.lower("Name").isin("aggregated", "total")
    place = F.when(is_total, F.col(row_order)).otherwise(-F.col(row_order))
    first = load_stats.orderBy(F.when(is_total, 0).otherwise(1), place).limit(1)
    requests, failures = F.col("Request Count"), F.col("Failure Count")
    return first.select(
        requests.alias("requests"), failures.alias("failures"),
        error_rate(failures, requests).alias("error_rate"),
        F.coalesce("Median Response Time", "`50%`").alias("median_ms"),
        F.col("Average Response Time").alias("mean_ms"),
        F.col("`95%`").alias("p95_ms"), F.col("`99%`").alias("p99_ms"),
        F.col("`Requests/s`").alias("rps"),
    )


def _totals(query_log: DataFrame) -> DataFrame:
    return query_log.groupBy("query").agg(
        F.count("*").alias("calls"), F.sum(F.col("duration_ms").cast("decimal(24,6)")).alias("_total"),
        F.sum("rows").alias("rows"))


def _top(totals: DataFrame, n: int) -> DataFrame:
    return totals.orderBy(F.col("_total").desc(), "query").limit(n).select(
        F.substring("query", 1, 120).alias("query_preview"), "calls",
        F.round("_total", 2).cast("double").alias("total_ms"),
        F.round(F.col("_total") / F.col("calls"), 2).cast("double").alias("mean_ms"), "rows")


def top_statements(query_log: DataFrame, n: int = 20) -> DataFrame:
    """The `n` statements with the most total time: 120-character preview, calls, total and
    mean milliseconds with two decimals, rows."""
    return _top(_totals(query_log), n)


def top_statements_bounded(query_log: DataFrame, n: int = 20,
                           buckets: int = 1 << 20) -> DataFrame:
    """The same rows where most statements differ, as with literals in their text.

    Statements are dealt into `buckets` by a hash, and a bucket's time bounds that of each statement in
    it; one number per bucket is shuffled, whatever the statements. The `n`-th best total of the
    statements in the fullest buckets is a floor, and only buckets that reach it can hold one of the
    best: their statements alone are totalled by text. With fewer than `n` statements there, or a
    floor of 0, all buckets are.
    """
    time = F.col("duration_ms").cast("decimal(24,6)")
    log = query_log.withColumn("_bucket", F.pmod(F.xxhash64("query"), F.lit(buckets)))
    bounds = materialize(log.groupBy("_bucket").agg(
        F.sum(F.greatest(time, F.lit(0).cast("decimal(24,6)"))).alias("_bound")))
    fullest = bounds.orderBy(F.col("_bound").desc(), "_bucket").limit(4 * n).select("_bucket")
    first = _totals(log.join(fullest, "_bucket", "left_semi")).orderBy(
        F.col("_total").desc()).limit(n)
    found = first.agg(F.count("*").alias("_n"), F.min("_total").alias("_floor"),
                      F.count("_total").alias("_known"))
    floor = found.select(F.when((F.col("_known") == n) & (F.col("_floor") > 0),
                                F.col("_floor"))).scalar()
    wanted = bounds.filter(F.coalesce(F.col("_bound") >= floor, F.lit(True))).select("_bucket")
    return _top(_totals(log.join(wanted, "_bucket", "left_semi")), n)
