"""Personal data against plain patterns and a plain count of what gives entities away."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import personal_data as pii

#: The patterns.
PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain_spans(text):
    found = [(m.start(), m.end(), kind) for kind, pattern in PATTERNS
             for m in re.finditer(pattern, text) if holds(kind, m[0])]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def entity_of(kind, value):
    if kind == "email":
        return kind, value.lower()
    if kind == "ip":
        return kind, tuple(map(int, value.split(".")))
    return kind, re.sub("[^0-9]", "", value)


def model(texts):
    """Per text its spans (start, end, kind, general), counted without Spark."""
    corpus, mentions = Counter(), Counter()
    near = defaultdict(lambda: defaultdict(set))
    places, spans = [], []
    for text in texts:
        text = text or ""
        spans.append(plain_spans(text))
        words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
        corpus.update(w for w, _, _ in words)
        free = [w for w in words if not any(a < w[2] and w[1] < b for a, b, _ in spans[-1])]
        here = set()
        for a, b, kind in spans[-1]:
            entity = entity_of(kind, text[a:b])
            mentions[entity] += 1
            around = [w for w in free if w[1] < a][-pii.NEAR:] + [
                w for w in free if w[1] >= b][:pii.NEAR]
            for w in around:
                here.add((entity, *w))
                near[entity][w[0]].add(tuple(x[0] for x in around))
        places.append(here)
    n_near = Counter((entity, w) for here in places for entity, w, _, _ in here)
    start, start_near = Counter(), Counter()
    for w, n in corpus.items():
        start[w[:3]] += n
    for (entity, w), n in n_near.items():
        start_near[entity, w[:3]] += n
    total = sum(corpus.values())

    def share(entity, n, all_n):
        ic = math.log2(total / mentions[entity])
        return (ic + math.log2(n / all_n)) / ic

    out = []
    for found, here in zip(spans, places):
        terms = {}
        for entity, w, a, b in here:
            if len(near[entity][w]) < 3 or share(entity, n_near[entity, w], corpus[w]) < 0.9:
                continue
            general = len(w) > 3 and share(
                entity, start_near[entity, w[:3]], start[w[:3]]) < 0.9
            terms[a, b] = general and terms.get((a, b), True)
        out.append(sorted([(a, b, k, False) for a, b, k in found] + [
            (a, b, "term", g) for (a, b), g in terms.items()],
            key=lambda s: (s[0], pii.KINDS.index(s[2]))))
    return out


def test_patterns_equal_plain_ones():
    rng = random.Random(4)
    for _ in range(20_000):
        letters = rng.choice(["a@.-_1 ", "12. -+()", "0123456789 -", "a@b.c@@..", "+1 (2)-.3"])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert [s[:3] for s in pii.base_spans(text)] == plain_spans(text)


@pytest.mark.parametrize("text, n", [("a" * 300_000, 0), ("1" * 300_000, 0), ("@" * 300_000, 0),
                                     ("1." * 150_000, 37_500), ("+1(" * 90_000, 0),
                                     ("1 " * 150_000, 0)])
def test_long_texts_take_linear_time(text, n):
    """The plain patterns would need hours here."""
    assert len(pii.base_spans(text)) == n


def corpus():
    rng = random.Random(9)
    fill = "the of and to in was for on with from this that have are".split()
    common = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{i}" for i in range(60)]

    def words(n):
        return " ".join(rng.choice(fill + common) for _ in range(n))

    texts = [words(60) for _ in range(40)]
    for i in range(6):
        # Two terms that stand near one address only; the start of one is common elsewhere.
        texts.append(f"{words(12)} Quixworth {words(3)} jane@mail.example.com {words(2)} "
                     f"thorvald {words(14)} tail9")
        texts.append(f"{words(9)} thor thorn thorax thora thorium {words(9)} 10.0.0.{i} {words(4)}")
    texts += [f"{words(5)} hapax{i} call +1 (555) 010-{i}999 {words(5)}" for i in range(5)]
    texts += ["copied zanzibar jane2@mail.example.com text here"] * 20
    return texts + [None, "", "@", words(4_000) + " jane@mail.example.com"]


def rows_of(found):
    return [[(s["start"], s["end"], s["kind"], s["general"]) for s in r["found"]] for r in found]


def test_terms_equal_plain_counts(spark):
    texts = corpus()
    want = model(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = pii.find_personal_data(df.repartition(5)).orderBy("doc_id").collect()
    assert rows_of(got) == want
    said = {(texts[i][a:b].lower(), general) for i, found in enumerate(want)
            for a, b, kind, general in found if kind == "term"}
    assert said == {("quixworth", False), ("thorvald", True)}


def test_sanitised_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(corpus())], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "thorvald" not in texts[40] and "tho*" in texts[40] and "[email]" in texts[40]
    assert "uixworth " not in texts[40] and texts[40].endswith("tail9")
    assert "thorium" in texts[41] and "[ip]" in texts[41]
    assert texts[3] == corpus()[3] and "zanzibar [email]" in texts[52 + 5]
    assert [texts[77], texts[78]] == [None, ""]


def test_overlapping_spans_leave_one_mark():
    found = [{"start": 0, "end": 9, "kind": "email", "general": False},
             {"start": 2, "end": 5, "kind": "card", "general": False},
             {"start": 9, "end": 12, "kind": "term", "general": False}]
    assert pii.sanitised("a23456@b.cxyz!", found) == "[email]z!"


def test_clashing_names_nulls_and_repeats(spark):
    rows = [(None, "x a@b.cd", 1, "r", "w", "f"), (None, "x a@b.cd", 1, "r", "w", "f"),
            (1, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, number int, row string, "
                                     "mentions string, found string")
    got = pii.find_personal_data(df)
    assert got.columns == ["doc_id", "text", "number", "row", "mentions", "found"]
    assert sorted(map(len, rows_of(got.collect()))) == [0, 1, 1]
    assert pii.find_personal_data(df.limit(0)).collect() == []


def test_query_equals_plain_patterns(spark):
    from tidemark.llm import queries

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in
             spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_personal_data"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [
            sum(s[2] == k for s in spans) for k in pii.KINDS[:4]]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("term:")] == (
            joined.split(",") if joined else [])
