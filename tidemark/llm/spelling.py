"""Grouping of spelling variants: words one error apart, found in a bidirectional FM-index.

The vocabulary is sorted and cut into shards, once as it is and once read backwards. Two words that
differ by one code point share the first or the second half of either, so a word meets only the shards
that can hold words with its first half, and those with its second half read backwards: nearly always
its own one and a neighbour. A shard is indexed in one task and its queries stream through in batches.
A task returns a count and the best near word per query, never the pairs.
"""

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, keep, scratch
from tidemark.llm.fm_index import WordIndex

#: Code points of the words of one shard.
SHARD_CHARS = 200_000
_BATCH = 4_096
_LAST = chr(0x10FFFF)


def vocabulary(words: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """Distinct values of the column `word` with at least `min_length` code points and their count
    `n`, where that is at least `min_count`. Nulls are no words."""
    return (words.filter(F.length("word") >= min_length).groupBy("word")
            .agg(F.count("*").alias("n")).filter(F.col("n") >= min_count))


def _router(bounds: list[tuple[int, str]], second: bool):
    """Send every word to the shards that can hold words with its exact half."""
    shards, lows = [b[0] for b in bounds], [b[1] for b in bounds]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, shard = [], []
            for i, word in enumerate(pdf["word"]):
                half = len(word) - len(word) // 2 if second else len(word) // 2
                first = max(0, bisect_right(lows, word[:half]) - 1)
                last = max(first, bisect_right(lows, word[:half] + _LAST) - 1)
                for k in range(first, last + 1):
                    at.append(i)
                    shard.append(shards[k])
            out = pdf.iloc[at].reset_index(drop=True)
            out["shard"], out["asked"] = np.array(shard, np.int32), True
            yield out[["shard", "asked", "word", "n"]]
    return run


def _search(second: bool):
    """Index the words of a shard and answer the queries that follow them."""
    def answer(index, words, counts, places, asked, n) -> pd.DataFrame:
        query, near = index.near(asked, second)
        # Per query the near word of largest n, of equal ones the first in code-point order.
        order = np.lexsort((places[near], -counts[near], query))
        query, near = query[order], near[order]
        total = np.bincount(query, minlength=len(asked))
        start = np.cumsum(total) - total
        some = total > 0
        best = np.full(len(asked), -1, np.int64)
        best[some] = near[start[some]]
        turn = (lambda w: w[::-1]) if second else (lambda w: w)
        return pd.DataFrame({
            "word": [turn(w) for w in asked], "n": n, "n_near": total,
            "near_n": np.where(some, counts[best], 0),
            "near": [turn(words[b]) if b >= 0 else None for b in best.tolist()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, words, counts, index, places = None, [], [], None, None
        for pdf in batches:
            changes = pdf["shard"].to_numpy()
            asked = pdf["asked"].to_numpy()
            cuts = np.flatnonzero((np.diff(changes) != 0) | (np.diff(asked.astype(int)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
                if a == b:
                    continue
                if changes[a] != shard:
                    shard, words, counts, index = changes[a], [], [], None
                if not asked[a]:
                    words += pdf["word"].iloc[a:b].tolist()
                    counts += pdf["n"].iloc[a:b].tolist()
                    continue
                if index is None:
                    index, counts = WordIndex(words), np.array(counts, np.int64)
                    places = np.empty(len(words), np.int64)
                    places[sorted(range(len(words)), key=lambda i: words[i][::-1])
                           if second else np.arange(len(words))] = np.arange(len(words))
                for at in range(a, b, _BATCH):
                    to = min(b, at + _BATCH)
                    yield answer(index, words, counts, places, pdf["word"].iloc[at:to].tolist(),
                                 pdf["n"].iloc[at:to].to_numpy())
    return run


_ANSWER = "word string, n long, n_near long, near_n long, near string"


def _searched(vocab: DataFrame, n_shards: int, second: bool, tables: Scratch) -> DataFrame:
    words = vocab.withColumn("word", F.reverse("word")) if second else vocab
    # Written, so that a task that runs again finds the same shards.
    cut = tables.table(words.repartitionByRange(n_shards, "word").sortWithinPartitions("word")
                       .select(F.spark_partition_id().alias("shard"), F.lit(False).alias("asked"),
                               "word", "n"))
    # One short row per shard, which is to say per SHARD_CHARS code points of the vocabulary.
    bounds = [(r["shard"], r["low"]) for r in
              cut.groupBy("shard").agg(F.min("word").alias("low")).orderBy("low").collect()]
    queries = cut.select("word", "n").mapInPandas(
        _router(bounds, second), "shard int, asked boolean, word string, n long")
    return (cut.unionByName(queries).repartition(max(n_shards, 1), "shard")
            .sortWithinPartitions("shard", "asked", "word")
            .mapInPandas(_search(second), _ANSWER))


def near_words(vocab: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """For every word of `vocab` (word, n; words distinct): n_near, the number of words one inserted,
    deleted or replaced code point away, and `near`, `near_n`, the one of largest n (ties: the first
    in code-point order; null without any). Words have two code points or more."""
    with scratch(vocab.sparkSession) as tables:
        vocab = tables.table(vocab.filter(F.col("word").isNotNull()).select(
            "word", F.col("n").cast("long").alias("n")))
        chars = vocab.agg(F.sum(F.length("word") + 1)).first()[0] or 0
        n_shards = -(-chars // shard_chars) or 1
        both = _searched(vocab, n_shards, False, tables).unionByName(
            _searched(vocab, n_shards, True, tables))
        best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").isNull().alias("none"),
                              "near"))
        return keep(both.groupBy("word").agg(
            F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("_best")).select(
            "word", "n", "n_near", F.col("_best.near").alias("near"),
            F.when(F.col("_best.near").isNotNull(), -F.col("_best.less")).alias("near_n")))


def variants(vocab: DataFrame, factor: int = 5, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Group spelling variants: word, form, root, n, n_near, form_n.

    `vocab` holds distinct words of two code points or more and their counts `n` of at least 1; other
    columns are ignored. A word's form is its near word of largest n, if that is `factor` times the
    word's or more, else null; its root is the last word reached from form to form, itself without a
    form. Words may have any length but hold no null character; null words are left out, and an empty
    vocabulary gives an empty table.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2, so that forms end")
    near = near_words(vocab, shard_chars)
    has_form = F.col("near_n") >= factor * F.col("n")
    found = near.select("word", F.when(has_form, F.col("near")).alias("form"), "n", "n_near",
                        F.when(has_form, F.col("near_n")).alias("form_n"))
    # Counts grow by `factor` from form to form, so a chain has so many steps at most; every join
    # doubles how many have been followed.
    largest = near.agg(F.max("n")).first()[0] or 1
    steps = 0
    while factor ** (steps + 1) <= largest:
        steps += 1
    with scratch(vocab.sparkSession) as tables:
        roots = tables.table(found.filter(F.col("form").isNotNull()).select(
            "word", F.col("form").alias("root")))
        for _ in range(max(0, steps - 1).bit_length()):
            further = roots.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
            roots = tables.table(roots.join(further, F.col("root") == F.col("_at"), "left").select(
                "word", F.coalesce("_next", "root").alias("root")))
        ends = roots.select(F.col("word").alias("_at"), "root")
        return keep(found.join(ends, F.col("word") == F.col("_at"), "left").select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
