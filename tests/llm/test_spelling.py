"""Spelling variants against a comparison of all pairs of a small vocabulary."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, spelling
from tidemark.llm.fm_index import WordIndex


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def model(counts, factor):
    out = {}
    for word, n in counts.items():
        near = [w for w in counts if w != word and one_apart(word, w)]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= factor * n else None
        out[word] = (form, n, len(near), counts[form] if form else None)
    whole = {}
    for word in out:
        root = word
        while out[root][0] is not None:
            root = out[root][0]
        whole[word] = (root, *out[word])
    return whole


def grouped(spark, counts, **options):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = spelling.variants(df, **options).collect()
    assert len(rows) == len(counts)
    return {r["word"]: (r["root"], r["form"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def vocabulary(seed, size, letters="abcé", longest=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(3, longest))):
            rng.choice([5, 6, 30, 150, 800, 4_000]) for _ in range(size)}


def test_index_finds_every_word_once():
    for seed in range(120):
        words = sorted(vocabulary(seed, 50, "abç"[:1 + seed % 3]))
        first = list(zip(*WordIndex(words).near(words, False)))
        turned = sorted(w[::-1] for w in words)
        second = list(zip(*WordIndex(turned).near(turned, True)))
        found = [(words[a], words[b]) for a, b in first] + [
            (turned[a][::-1], turned[b][::-1]) for a, b in second]
        assert sorted(found) == sorted(
            (a, b) for a in words for b in words if one_apart(a, b))


@pytest.mark.parametrize("shard_chars, letters", [(100_000, "abcé"), (60, "abcé"), (40, "ab")])
def test_variants_equal_all_pairs(spark, shard_chars, letters):
    counts = vocabulary(shard_chars, 160, letters)
    assert grouped(spark, counts, factor=5, shard_chars=shard_chars) == model(counts, 5)


def test_one_prefix_in_many_shards(spark):
    """All words share their first half, so every query meets every shard of the first search."""
    counts = {"aaaaaaaaaa" + w: n for w, n in vocabulary(3, 80, "abc", 8).items()}
    assert grouped(spark, counts, factor=3, shard_chars=200) == model(counts, 3)


def test_long_chain_of_forms(spark):
    counts = {"wort" + "x" * i: 2 ** (i + 1) for i in range(20)}
    got = grouped(spark, counts, factor=2, shard_chars=50)
    assert got == model(counts, 2)
    assert {r[0] for r in got.values()} == {"wort" + "x" * 19}


def test_ties_go_to_the_first_word(spark):
    counts = {"abcdef": 5, "abcdeg": 50, "abcdee": 50, "zbcdef": 50}
    assert grouped(spark, counts)["abcdef"] == ("abcdee", "abcdee", 5, 3, 50)


def test_empty_long_null_and_other_columns(spark):
    assert grouped(spark, {}) == {}
    long = "ab" * 20_000
    df = spark.createDataFrame(
        [(long, 5, "x", 1), (long[:-1], 100, "y", 2), (None, 9, "z", 3)],
        "word string, n int, near string, shard int")
    got = {r["word"]: r["form"] for r in spelling.variants(df).collect()}
    assert got == {long: long[:-1], long[:-1]: None}
    with pytest.raises(ValueError):
        spelling.variants(df, factor=1)


def test_runs_of_texts(spark):
    texts = [(1, "Straße STRASSE. straßen×x ab1cdefgh"), (None, "Éclairs éclairs"), (2, None), (3, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("w"))
    got = sorted(r["word"] for r in queries._runs(docs).collect())
    assert got == sorted(["straße", "strasse", "straßen×x", "cdefgh", "Éclairs", "éclairs"])


def test_vocabulary_counts(spark):
    df = spark.createDataFrame([("abcdef",)] * 5 + [("abcdeg",)] * 4 + [("abc",)] * 9 + [(None,)],
                               "word string")
    assert [tuple(r) for r in spelling.vocabulary(df).collect()] == [("abcdef", 5)]
