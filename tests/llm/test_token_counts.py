import random

import pytest

from tidemark.llm.token_counts import Counter, Merges, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    random.seed(3)

    def letter():
        return chr(random.choice([
            random.randrange(32, 127), random.randrange(0x250), random.randrange(0x3000),
            random.randrange(0xD000), random.randrange(0xE000, 0x1FFFF), 32, 10, 0x85, 0xA0, 0x2028]))

    return ["", "a", "a" * 12, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext",
            "  \n\n  x ", "é" * 50, "a\u0558b \u088f1 \U00018d80x \U0003d000", "\U000323b0" * 9, " " * 100 + "x", "don't we'll I'M", "!" * 999, "ab" * 500,
            "".join(random.choice("abcdefgh") for _ in range(20_000))] + [
        "".join(letter() for _ in range(random.randrange(60))) for _ in range(3000)]


def test_counts_equal_the_library(library, texts):
    with open(PATH, encoding="utf-8") as file:
        counter = Counter(Merges(file.read()))
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.counts(texts) == want
    assert counter.counts(texts) == want  # remembered


def test_forgetting_changes_nothing(library, texts, monkeypatch):
    from tidemark.llm import token_counts as module

    monkeypatch.setattr(module, "REMEMBERED", 50)
    monkeypatch.setattr(module, "SYMBOLS_AT_ONCE", 64)
    with open(PATH, encoding="utf-8") as file:
        counter = Counter(Merges(file.read()))
    part = texts[:12] + texts[13:300]
    want = [len(x.ids) for x in library.encode_batch(part, add_special_tokens=False)]
    assert [counter.counts([t])[0] for t in part] == want


def test_rows(spark, library):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, "x"), (2, None), (3, ""),
            (4, "word " * 600)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_tokens int")
    out = token_counts(frame, PATH)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(d, len((t or "").encode()), len(library.encode(t or "").ids)) for d, t in rows]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        ((*w, w[2] > 512) for w in want), key=str)
    assert token_counts(frame.limit(0), PATH).count() == 0
