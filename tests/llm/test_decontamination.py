import random

import numpy as np
import pytest

from tidemark.llm import decontamination
from tidemark.llm.decontamination import Limits, build_index

random.seed(5)
VOCABULARY = [f"w{i}" for i in range(400)]
WEIGHTS = [1 / (i + 1) for i in range(400)]


def prose(n):
    return " ".join(random.choices(VOCABULARY, WEIGHTS, k=n))


def items(n=150):
    return [(i, prose(random.randint(5, 50)) + ". " + prose(random.randint(1, 12))) for i in range(n)]


def test_wand_finds_all_items_above_the_threshold():
    index = build_index(items(), Limits(share=0.3))
    scores = np.zeros((len(index.terms), index.size))
    for t, (who, impact) in enumerate(index.postings):
        scores[t, who] = impact
    found = 0
    for _ in range(200):
        terms = np.unique(np.random.default_rng(random.randrange(10 ** 9)).integers(
            0, len(index.terms), random.randint(1, 120)))
        total = scores[terms].sum(0)
        want = {i for i in range(index.size) if total[i] >= 0.3 - 1e-9}
        got = dict(index.retrieve(terms))
        assert set(got) == want
        assert all(abs(got[i] - total[i]) < 1e-9 for i in got)
        found += len(want)
    assert found > 100


def run(spark, docs, bench, **options):
    docs = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, score double")
    bench = spark.createDataFrame(bench, "item_id long, text string")
    rows = decontamination.find_leaks(docs, bench, **options).collect()
    clean = decontamination.without_leaks(docs, bench, **options)
    assert clean.columns == ["doc_id", "text", "score"]
    return (sorted(((r.doc_id, r.item_id) for r in rows), key=str),
            sorted((r.doc_id for r in clean.collect()), key=str))


@pytest.mark.parametrize("max_items", [4000, 7])
def test_planted_items_are_found_and_clean_documents_stay(spark, monkeypatch, max_items):
    monkeypatch.setattr(decontamination, "MAX_ITEMS", max_items)
    rare = [f"r{i}" for i in range(5000)]
    bench = [(i, " ".join(random.sample(rare, 20)) + "? " + " ".join(random.sample(rare, 6)))
             for i in range(40)]
    docs, want = [], []
    for d in range(120):
        text = prose(random.randint(0, 400)).split()
        if d % 3 == 0:
            item, passage = random.choice(bench)
            if d % 2:
                passage = passage.upper().replace(" ", ", ")
            at = random.randint(0, len(text))
            text[at:at] = passage.split()
            want.append((d, item))
        elif d % 3 == 1:  # a few words of an item are no leak
            text += bench[d % 40][1].split()[:4]
        docs.append((d, " ".join(text)))
    pairs, clean = run(spark, docs, bench)
    assert pairs == sorted(want, key=str)
    assert clean == sorted((d for d, _ in docs if d % 3), key=str)


def test_question_without_answer_and_answer_alone(spark):
    question = " ".join(f"q{i}" for i in range(12))
    answer = " ".join(f"a{i}" for i in range(12))
    pairs, _ = run(spark, [(1, f"{question} {answer}"), (2, question), (3, answer)],
                   [(9, f"{question}\n{answer}")])
    assert pairs == [(1, 9)]


def test_special_rows(spark):
    bench = [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six"),
             (None, "no id here at all"), (3, None), (4, " .. "), (5, "Solo")]
    docs = [(1, "x alpha beta gamma delta epsilon zeta y"), (1, "x alpha beta gamma delta epsilon zeta y"),
            (None, "one two three four five six"), (2, None), (3, ""), (4, "say solo now"),
            (5, "word " * 50_000 + "one two three four five six")]
    pairs, clean = run(spark, docs, bench)
    assert pairs == sorted([(1, 1), (1, 1), (None, 1), (4, 5), (5, 1)], key=str)
    assert clean == [2, 3]
    assert run(spark, [], bench) == ([], [])
    assert run(spark, docs[:1], []) == ([], [1])


def test_items_that_share_an_id_have_parts_of_their_own(spark):
    one, two, three = (" ".join(f"{k}{i}" for i in range(7)) for k in "abc")
    bench = [(1, f"{one}\nyes"), (1, f"{two}\nno"), (1, f"{three}\nnot at all")]
    docs = [(1, f"{one} so yes"), (2, f"{two} so no"), (3, f"{three} so not at all"),
            (4, f"{one} so no")]
    pairs, clean = run(spark, docs, bench)
    assert pairs == [(1, 1), (2, 1), (3, 1)] and clean == [4]


def test_a_short_answer_does_not_stand_for_a_question_of_its_length(spark):
    bench = [(1, "who won\nnot me")]
    pairs, clean = run(spark, [(1, "not me"), (2, "who won"), (3, "who won then not me")], bench,
                       limits=Limits(share=0.3))
    assert pairs == [(3, 1)] and clean == [1, 2]


@pytest.mark.parametrize("max_items", [1, 3, 5, 4000])
def test_indexes_of_any_size_find_the_same(spark, monkeypatch, max_items):
    """Items that share most of their words: how rare a word is must not hang on the index."""
    monkeypatch.setattr(decontamination, "MAX_ITEMS", max_items)
    common = " ".join(f"common{i}" for i in range(10))
    bench = [(i, f"{common} own{i}a own{i}b own{i}c? answer{i}") for i in range(8)] + [
        (8, "..."), (9, f"{common} own0a own0b own0c? answer0")]
    docs = [(1, common + " and nothing else of any item"), (2, bench[3][1]), (3, f"{common} own5a"),
            (4, f"x {bench[0][1]} y")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = decontamination.find_leaks(frame, spark.createDataFrame(bench, "item_id long, text string"))
    got = sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in rows.collect())
    assert [g[:2] for g in got] == [(2, 3), (4, 0), (4, 9)]
    monkeypatch.setattr(decontamination, "MAX_ITEMS", 4000)
    rows = decontamination.find_leaks(frame, spark.createDataFrame(bench, "item_id long, text string"))
    assert got == sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in rows.collect())
