"""Bounded samples of labelled rows, for models that one task fits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most `rows` documents that may be learned from, one row each.

    The rows with the lowest hash of their id are drawn, so the draw depends on the ids alone. The
    ids and labels are at most `rows` pairs of numbers, which bounds what is broadcast. Of different
    texts with one id the one with the lowest hash is learned from, whatever the order of the rows.
    """
    drawn = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.col(label).cast("int").alias("y"))
             .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
             .groupBy("doc_id").agg(F.max("y").alias("y"))
             .orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(rows))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
            .join(F.broadcast(drawn), "doc_id")
            .groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("r"))
            .select("doc_id", "r.text", "r.y"))
