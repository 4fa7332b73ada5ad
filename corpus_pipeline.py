"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. It works on all that the stage
before kept; all stages but the last return the columns of `documents`, the last one adds the
training position of every copy that the mix takes.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, line_dedup, mixing, ngram_join, quality
from tidemark.llm.common import free_name, keep, scratch

#: A document whose probability of good quality is lower is rejected.
MIN_QUALITY = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = free_name("_score", docs.columns)
    scored = quality.with_quality(docs, labels, column=score)
    return scored.filter(F.col(score) >= MIN_QUALITY).drop(score)


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that spread over many sites; those of nothing else go."""
    # Columns of these names are the documents' own here.
    aside, taken = {}, list(docs.columns)
    for c in docs.columns:
        if c.lower() in ("n_lines", "n_removed"):
            aside[c] = free_name(f"_{c}", taken)
            taken.append(aside[c])
    cleaned = line_dedup.remove_spread_lines(docs.withColumnsRenamed(aside))
    left = cleaned.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))).drop(
        "n_lines", "n_removed").withColumnsRenamed({new: c for c, new in aside.items()})
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 on five-word n-grams."""
    return ngram_join.one_per_component(docs, n_words=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order of the mix, a row per copy."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_spread_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: The quality classifier cannot be said in SQL, so the rows of the whole cannot either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each result written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as tables:
        for _, stage in STAGES[:-1]:
            docs = tables.table(stage(spark, docs, sf_dir))
        return keep(STAGES[-1][1](spark, docs, sf_dir))
