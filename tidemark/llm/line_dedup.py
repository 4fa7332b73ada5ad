"""Removal of boilerplate lines that spread over many sites, with DataFrame functions only.

Per distinct line a HyperLogLog sketch of the sites it occurs on is merged by one aggregation.
Lines far below or above the threshold are decided by the sketch; those whose estimate lies within
a few standard errors of it get an exact distinct count. The first occurrence of a line stays.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, free_name, keep, scratch, without

MIN_SITES = 10
SKETCH_BITS = 10
#: Half width of the band of exact counts, in standard errors of the sketch.
BAND = 6


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("null"))


def _lines(docs: DataFrame, site: str) -> DataFrame:
    trimmed = F.btrim(F.col("line"), F.lit(" \t\r"))
    return (docs.select("doc_id", F.xxhash64("text").alias("version"), _key(site).alias("site"),
                        F.posexplode(F.split("text", "\n")).alias("at", "line"))
            .withColumn("line", trimmed).filter("line <> ''")
            .select("doc_id", "version", "site", "at", F.xxhash64("line").alias("h"),
                    F.xxhash64(F.lit(1), "line").alias("g")))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, g, first) of the lines that occur on `min_sites` sites or more."""
    line = ["h", "g"]
    sketched = lines.groupBy(*line).agg(
        F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"), F.count("*").alias("n"),
        F.min(F.struct("doc_id", "version", "at")).alias("first")).filter(
        F.col("n") >= min_sites).select(
        *line, "first", F.hll_sketch_estimate("sketch").alias("sites"))
    error = BAND * 1.04 / 2 ** (SKETCH_BITS / 2)
    low, high = min_sites / (1 + error) - 1, min_sites * (1 + error) + 1
    return sketched.filter(F.col("sites") > low).withColumn("sure", F.col("sites") >= high)


def flagged_lines(lines: DataFrame, tables: Scratch, min_sites: int = MIN_SITES) -> DataFrame:
    line = ["h", "g"]
    found = tables.table(spread_lines(lines, min_sites))
    near = found.filter("not sure")
    exact = (lines.join(near.select(*line), line, "left_semi").select(*line, "site").distinct()
             .groupBy(*line).agg(F.count("*").alias("k")).filter(F.col("k") >= min_sites))
    return tables.table(found.filter("sure").select(*line, "first").union(
        near.join(exact, line, "left_semi").select(*line, "first")))


def remove_spread_lines(docs: DataFrame, site: str = "source",
                        min_sites: int = MIN_SITES) -> DataFrame:
    """All columns of `docs`, the text without boilerplate lines, and n_lines and n_removed.

    A line is what newlines separate, without spaces, tabs and carriage returns around it. Lines on
    `min_sites` distinct sites or more are removed everywhere but at their first occurrence, by
    doc_id and line. Blank lines are never counted or removed; the other lines stay as they are.

    A null text stays null with no lines, an empty text stays empty, texts have any length. A null site is one site. A null
    doc_id comes before all others. Repeated rows are treated alike, so the first occurrence stays
    in each of them. Columns named n_lines or n_removed are replaced. An empty table gives an empty
    table.
    """
    docs = docs.select(*[docs[f"`{c}`"] for c in without(docs.columns, ("n_lines", "n_removed"))])
    gone, gone_id, gone_version = (free_name(n, docs.columns) for n in ("_removed", "_id", "_version"))
    with scratch(docs.sparkSession) as tables:
        lines = tables.table(_lines(docs, site))
        flagged = flagged_lines(lines, tables, min_sites)
        here = F.struct("doc_id", "version", "at")
        removed = keep(lines.join(flagged, ["h", "g"])
                       .filter(~here.eqNullSafe(F.col("first")))
                       .select(F.col("doc_id").alias(gone_id), F.col("version").alias(gone_version),
                               "at")
                       .groupBy(gone_id, gone_version).agg(F.collect_set("at").alias(gone)))
    same = docs["doc_id"].eqNullSafe(F.col(gone_id)) & (
        F.xxhash64(docs["text"]) == F.col(gone_version))
    parts = F.split(docs["text"], "\n")
    # By a hash of the numbers, so that a long text costs no more per line than a short one.
    stays = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    left = F.transform(stays, lambda i: F.get(parts, i))
    whole = F.filter(parts, lambda x: F.btrim(x, F.lit(" \t\r")) != "")
    return docs.join(removed, same, "left").select(
        *[F.when(F.col(gone).isNull(), docs["text"])
          .otherwise(F.array_join(left, "\n")).alias("text") if c == "text" else docs[f"`{c}`"]
          for c in docs.columns],
        F.coalesce(F.size(whole), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).alias("n_removed"))
