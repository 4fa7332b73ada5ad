import random

import numpy as np
import pyarrow as pa
import pytest

import brute
from tidemark.llm import words


@pytest.fixture(scope="module")
def texts():
    random.seed(1)
    pool = ["the", "of", "é", "Word", "x" * 300, "the", "WORD"]
    return ["", None, "a", "Ab cD", " x\ty\n\x0bz ", "é ü ñ"] + [
        random.choice([" ", "\n", "  "]).join(random.choices(pool, k=random.randint(0, 30)))
        for _ in range(200)]


@pytest.mark.parametrize("size", [7, 50, 1 << 20])
def test_words_are_those_between_white_space(texts, size):
    doc, hashes = [], []
    for d, h, _, _ in words.words(pa.array(texts), size=size):
        doc += d.tolist()
        hashes += h.tolist()
    want = [(i, w) for i, t in enumerate(texts) for w in brute.words(t)]
    assert doc == [i for i, _ in want]
    seen = {}
    assert all(seen.setdefault(w, h) == h for (_, w), h in zip(want, hashes))
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_shingles_are_runs_of_words(texts, n):
    doc, hashes, _, _ = words.all_words(pa.array(texts))
    got_doc, got = words.shingles(doc, hashes, n)
    want = []
    for i, t in enumerate(texts):
        w = brute.words(t)
        want += [(i, tuple(w[k:k + n])) for k in range(max(1, len(w) - n + 1))] if w else []
    assert got_doc.tolist() == [i for i, _ in want]
    seen = {}
    assert all(seen.setdefault(x, h) == h for (_, x), h in zip(want, got.tolist()))
    assert len(set(seen.values())) == len(seen)


def test_empty_batches():
    for texts in ([], [None], [""], ["  \n"]):
        doc, hashes, _, _ = words.all_words(pa.array(texts, pa.string()))
        assert len(doc) == len(hashes) == 0
        assert len(words.shingles(doc, hashes, 3)[0]) == 0


def test_slices_of_an_array_are_read_at_their_offset():
    whole = pa.array(["a b", "c", None, "d e f"])
    doc, hashes, _, _ = words.all_words(whole.slice(1))
    same = words.all_words(pa.array(["c", None, "d e f"]))
    assert (doc == same[0]).all() and (hashes == same[1]).all()
    assert np.unique(hashes).size == 4
