"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (both.join(least, "a").filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m"))
            .union(least.select("a", "m")).toDF("a", "b").distinct())


def components(edges: DataFrame, tables: Scratch) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge to another.

    `edges` holds two integer columns `a` and `b`. Every round keeps at most as many edges as
    before; a round is written, so neither lineage nor lost executors add up. Rounds end when
    nothing changes, after about the logarithm of the longest path.
    """
    now = tables.table(edges.filter("a <> b").select("a", "b").distinct())
    before = None
    while True:
        now = tables.table(_small_star(_large_star(now)))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(state)
