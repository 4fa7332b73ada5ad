"""Mixing of sources to target weights along a time-varying curriculum.

Every source is a stream of its documents in a fixed random order, repeated if the target asks for
more than the source has. A schedule says how the source's weight changes over the training run.
Its integral is the cumulative token demand; inverting it at the token a document starts with gives
the document's training position, and a range sort by position is the training order.

The running token counts come from two levels of sums, per slice of the random order and within
each slice, so that no task handles a whole source.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Scratch, keep, scratch, without

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_SLICE = 20_000


@dataclass(frozen=True)
class Curriculum:
    """`weights` and `schedules` repeat over the sources in code point order, a null source last.

    A schedule is a line through (time, level) points, with times rising from 0 to 1 and levels of
    at least 0; only its shape counts. `share` of all words are taken, no source more than
    `max_epochs` (at most 2) times.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share_percent: int = 150
    max_epochs: int = 2
    schedules: tuple[tuple[tuple[float, float], ...], ...] = (
        ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)))


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def position(demand: Column, schedule) -> Column:
    """Invert a schedule's normalised integral: the time at which this share of words is used."""
    area, parts = 0.0, []
    for (t0, l0), (t1, l1) in zip(schedule, schedule[1:]):
        parts.append((area, t0, l0, (l1 - l0) / (t1 - t0)))
        area += (t1 - t0) * (l0 + l1) / 2
    out = None
    for start, t0, level, slope in reversed(parts):
        d = demand * F.lit(area) - F.lit(start)
        root = F.sqrt(F.lit(level * level) + F.lit(2 * slope) * d)
        # The stable form of the quadratic's root also holds for a slope of zero.
        here = F.when(d <= 0, F.lit(t0)).otherwise(F.lit(t0) + 2 * d / (F.lit(level) + root))
        out = here if out is None else F.when(demand * F.lit(area) < F.lit(parts[parts.index(
            (start, t0, level, slope)) + 1][0]), here).otherwise(out)
    return out


def _streams(docs: DataFrame, curriculum: Curriculum, sliced: int) -> DataFrame:
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return (docs.withColumn("_size", words_in(F.col("text")))
            .withColumn("_stream", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))
            .withColumn("_order", order)
            .withColumn("_slice", F.substring("_order", 1, sliced)))


def _ranked(sources: DataFrame, tables: Scratch) -> DataFrame:
    """Number the sources in code point order, a null one last, by a range sort and its counts."""
    parts = 4
    placed = tables.table(
        sources.withColumn("_last", F.col("source").isNull())
        .repartitionByRange(parts, "_last", "source").sortWithinPartitions("_last", "source")
        .withColumn("_at", F.monotonically_increasing_id())).drop("_last")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # At most `parts` counts come to the driver.
    counts = dict(placed.groupBy(part.alias("p")).count().collect())
    before, total = F.lit(0), 0
    for p in sorted(counts):
        before = F.when(part == p, F.lit(total)).otherwise(before)
        total += counts[p]
    return placed.withColumn("rank", (before + row).cast("long")).drop("_at")


def _targets(sources: DataFrame, curriculum: Curriculum, tables: Scratch) -> DataFrame:
    """Share the words by weight, cap each source, and share the excess until none is above.

    Every round caps all sources that are above and needs one aggregate; there are at most as many
    rounds as sources, usually two or three.
    """
    w = F.element_at(F.array(*map(F.lit, curriculum.weights)),
                     (F.col("rank") % len(curriculum.weights) + 1).cast("int")).cast("long")
    cap = curriculum.max_epochs * F.col("source_size")
    now = tables.table(_ranked(sources, tables).withColumn("w", w)
                       .withColumn("capped", F.col("source_size") == 0))
    total = now.agg(F.sum("source_size")).first()[0] or 0
    asked = curriculum.share_percent * total  # in hundredths of a word, so that all is exact
    while True:
        free, used, changed = now.agg(
            F.sum(F.when(~F.col("capped"), F.col("w")).otherwise(0)),
            F.sum(F.when(F.col("capped"), cap).otherwise(0)), F.count("*")).first()
        rest = asked - 100 * (used or 0)
        above = ~F.col("capped") & (F.col("w") * F.lit(rest) > 100 * cap * F.lit(free or 0))
        if not changed or not free or not now.filter(above).limit(1).count():
            break
        now = tables.table(now.withColumn("capped", F.col("capped") | above))
    exact = F.col("w") * F.lit(rest)
    divisor = F.lit(100 * (free or 1))
    return (now.withColumn("target", F.when(F.col("capped"), cap.cast("double"))
                           .otherwise(exact.cast("double") / divisor.cast("double")))
            .withColumn("_whole", F.when(F.col("capped"), cap).otherwise(
                F.floor((exact - exact % divisor) / divisor)).cast("long")))


def place(docs: DataFrame, curriculum: Curriculum = Curriculum()) -> DataFrame:
    """All rows and columns of `docs` with size, source_size, target, taken, first_position and
    second_position. The last document of a source's share is cut at the target: `taken` counts
    the words of it that the mix still takes. Columns of these names are replaced.
    """
    kept = without(docs.columns, _OUT)
    placed = _placed(docs, curriculum, kept)
    return placed.select(*[F.col("row")[c].alias(c) for c in kept], *_OUT)


def _placed(docs: DataFrame, curriculum: Curriculum, kept: list[str]) -> DataFrame:
    """`row`, a struct of the columns `kept` of `docs`, and the result's own columns."""
    key = ["_stream", "_slice"]
    with scratch(docs.sparkSession) as tables:
        rows = tables.table(_streams(docs.select("doc_id", "source", "text"), curriculum, 8)
                            .select("source", *key, "_size"))
        count, sliced = rows.count(), 1
        while sliced < 8 and 16 ** sliced * ROWS_PER_SLICE < count:
            sliced += 1
        sums = tables.table(rows.withColumn("_slice", F.substring("_slice", 1, sliced))
                            .groupBy(*key).agg(F.sum("_size").alias("_in"),
                                               F.first("source").alias("source")))
        sources = sums.groupBy("_stream").agg(F.sum("_in").alias("source_size"),
                                              F.first("source").alias("source"))
        targets = _targets(sources, curriculum, tables).drop("source")
        before = F.sum("_in").over(Window.partitionBy("_stream").orderBy("_slice")) - F.col("_in")
        offsets = keep(sums.select(*key, before.alias("_before"))
                       .join(targets, "_stream").drop("w", "capped"))
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("row"), "doc_id", "source",
                         "text")
    whole, size = F.col("_whole"), F.col("_size")
    within = Window.partitionBy(*key).orderBy("_order", "doc_id", "_size").rowsBetween(
        Window.unboundedPreceding, 0)
    start = F.col("_before") + F.sum("_size").over(within) - size
    placed = _streams(packed, curriculum, sliced).join(offsets, key).withColumn("_start", start)
    first = F.greatest(F.lit(0), F.least(size, whole - F.col("_start")))
    second = F.greatest(F.lit(0), F.least(size, whole - F.col("source_size") - F.col("_start")))
    return placed.select(
        "row", size.alias("size"), "source_size", "target",
        (first + second).alias("taken"),
        _position(curriculum, F.col("_start"), first).alias("first_position"),
        _position(curriculum, F.col("source_size") + F.col("_start"), second)
        .alias("second_position"))


_OUT = ("size", "source_size", "target", "taken", "first_position", "second_position")


def _position(curriculum: Curriculum, start: Column, taken: Column) -> Column:
    share = start.cast("double") / F.col("_whole").cast("double")
    out = F.lit(None).cast("double")
    for i, schedule in enumerate(curriculum.schedules):
        out = F.when(F.col("rank") % len(curriculum.schedules) == i,
                     position(share, schedule)).otherwise(out)
    return F.when(taken > 0, out)


def mix(docs: DataFrame, curriculum: Curriculum = Curriculum()) -> DataFrame:
    """The training order: a row per copy that the mix takes, range-sorted by `position`.

    Reads `doc_id`, `text` and `source`. All columns of `docs` stay, but for clashing names of the
    result's own columns, which are replaced: size, source_size, target, taken (words of this
    copy), copy (0 or 1) and position (0 to 1). Texts are whole and of any length; where `taken` is
    below `size`, the mix ends in this document.

    A null or empty text has size 0 and is never taken. A null source is a source of its own, last
    in order. Ties of doc_id are ordered by size, repeated rows take part one by one. A null doc_id
    counts like an empty one. An empty table gives an empty table. The same input gives the same
    mix, however it is partitioned.
    """
    own = ["size", "source_size", "target"]
    kept = without(docs.columns, [*own, "copy", "position", "taken"])
    placed = _placed(docs, curriculum, kept)
    copies = F.filter(F.array(
        F.struct(F.lit(0).alias("copy"), F.col("first_position").alias("position"),
                 F.least("size", "taken").alias("taken")),
        F.struct(F.lit(1).alias("copy"), F.col("second_position").alias("position"),
                 (F.col("taken") - F.col("size")).alias("taken")),
    ), lambda c: c["position"].isNotNull())
    rows = placed.select(*[F.col("row")[c].alias(c) for c in kept], *own, F.inline(copies))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartitionByRange(parts, "position", "doc_id")
            .sortWithinPartitions("position", "doc_id"))


def shares(docs: DataFrame, curriculum: Curriculum = Curriculum()) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken and the
    training positions of its first and second copy in millionths of the run (null: not taken).
    Rows and special cases are those of `mix`; documents it does not take are returned too.
    """
    millionth = 1_000_000
    placed = _placed(docs, curriculum, ["doc_id"])
    return placed.select(
        F.col("row")["doc_id"].alias("doc_id"), "size", "source_size", "target", "taken",
        *[F.floor(F.col(c) * millionth).cast("long").alias(c)
          for c in ("first_position", "second_position")])
