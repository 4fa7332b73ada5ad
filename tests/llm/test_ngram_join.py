import random

import pytest

import brute
from tidemark.llm import ngram_join

SCHEMA = "doc_id long, text string, hi string, component_id int"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)


def result(spark, rows, n, percent):
    out = ngram_join.ngram_components(table(spark, rows), n, percent)
    return sorted(((r[0], r[1], r[2]) for r in out.collect()), key=str)


def near_copies(seed, group, length, edits):
    random.seed(seed)
    base = [f"w{random.randrange(10 ** 6)}" for _ in range(length)]
    out = []
    for _ in range(group):
        copy = list(base)
        for _ in range(random.randrange(edits + 1)):
            copy[random.randrange(length)] = f"v{random.randrange(10 ** 6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, n, percent):
    texts = (near_copies(1, 40, 120, 4) + near_copies(2, 25, 400, 16) + near_copies(3, 30, 30, 2)
             + near_copies(4, 12, 1500, 60) + ["a b", "A B", "a  b", "b a", "a", "", None, " \n"]
             + [" ".join(random.choices("abc", k=random.randint(1, 6))) for _ in range(60)])
    random.shuffle(texts)
    rows = list(enumerate(texts))
    got = result(spark, rows, n, percent)
    want = sorted(brute.components(rows, n, percent), key=str)
    assert got == want
    assert len({c for _, s, c in got if s}) < len([1 for _, s, _ in got if s]) - 50


def test_sizes_around_the_border_of_whole_and_cut_sets(spark):
    texts = []
    for length in (180, 199, 200, 201, 205, 215, 222, 225, 240):
        texts += near_copies(length, 6, length, 5)
    texts += [" ".join(t.split()[:190]) for t in texts[-12:]]
    rows = list(enumerate(texts))
    assert result(spark, rows, 3, 90) == sorted(brute.components(rows, 3, 90), key=str)


def test_nulls_and_repeated_rows(spark):
    rows = [(3, "one two three four"), (3, "one two three four"), (None, "one two three four"),
            (5, "one two three four"), (5, "quite another text here"), (None, "lonely words of it"),
            (None, None), (7, ""), (7, "")]
    assert result(spark, rows, 3, 90) == sorted([
        (3, 2, 3), (3, 2, 3), (None, 2, 3), (5, 2, 3), (5, 2, 5), (None, 2, None), (None, 0, None),
        (7, 0, 7), (7, 0, 7)], key=str)


def test_empty_table(spark):
    assert result(spark, [], 3, 90) == []
    assert ngram_join.one_per_component(table(spark, [])).count() == 0


def test_very_long_text(spark):
    text = near_copies(9, 1, 60000, 0)[0]
    rows = [(1, text), (2, text + " end"), (3, "short one of words")]
    assert result(spark, rows, 3, 90) == [(1, 59998, 1), (2, 59999, 1), (3, 2, 3)]


def test_many_rows_at_one_hub_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    rows = list(enumerate(near_copies(11, 60, 60, 5)))
    assert result(spark, rows, 3, 90) == sorted(brute.components(rows, 3, 90), key=str)


def test_one_row_of_each_component_stays_with_all_columns(spark):
    copies = near_copies(5, 10, 100, 1)
    rows = [(i + 10, t) for i, t in enumerate(copies)] + [
        (10, copies[0]), (4, "all alone in the world it is"), (4, "same id but other text that is"),
        (None, copies[3]), (None, "no id at all has this one"), (None, "no id at all has this one"),
        (8, None)]
    out = ngram_join.one_per_component(table(spark, rows))
    assert out.columns == ["doc_id", "text", "hi", "component_id"]
    got = sorted(((r[0], r[1]) for r in out.collect()), key=str)
    assert got == sorted([(10, copies[0]), (4, "all alone in the world it is"),
                          (4, "same id but other text that is"),
                          (None, "no id at all has this one"), (8, None)], key=str)
