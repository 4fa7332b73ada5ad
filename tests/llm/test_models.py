import random
import zlib

import numpy as np
import pytest

from tidemark.llm import quality, toxicity
from tidemark.llm.quality import Settings as QualitySettings

FILLER = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "nrst"]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def frames(spark, texts, labels):
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in enumerate(texts)],
                                 "doc_id long, text string, score string, y int")
    known = spark.createDataFrame([(i, *y) for i, y in enumerate(labels) if y is not None],
                                  "doc_id long, quality int, toxic int")
    return docs, known


@pytest.fixture(scope="module")
def corpus():
    random.seed(3)
    texts, labels = [], []
    for i in range(1500):
        text = random.choices(FILLER, k=random.randint(20, 200))
        insult, group = random.random() < 0.4, random.random() < 0.4
        if insult:
            text.insert(random.randrange(len(text)), "insult" + random.choice("abc"))
        if group:
            text.insert(random.randrange(len(text)), "group" + random.choice("abc"))
        junk = random.random() < 0.2
        if junk:
            text = [w + random.choice(["***", "!!"]) for w in text]
        texts.append(" ".join(text))
        labels.append((int(not junk), int(insult and group)))
    return texts, labels


def accuracy(rows, labels, at):
    picked = [r for r in rows if r.held_out]
    assert len(picked) > 200
    return np.mean([r.predicted == labels[r.doc_id][at] for r in picked])


def test_quality_on_held_out_rows(spark, corpus):
    texts, labels = corpus
    docs, known = frames(spark, texts, labels)
    out = quality.quality_scores(docs, known)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert all(r.held_out == held(r.doc_id) for r in rows) and len(rows) == 1500
    assert accuracy(rows, labels, 0) > 0.98


def test_interactions_are_learned(spark, corpus):
    texts, labels = corpus
    docs, known = frames(spark, texts, labels)
    rows = toxicity.toxicity_scores(docs, known, threshold=0.5, settings=toxicity.Settings(
        association=3.0, epochs=40)).collect()
    assert accuracy(rows, labels, 1) > 0.95  # an insult or a group alone is not toxic


def test_held_out_labels_are_not_learned(spark, corpus):
    texts, labels = corpus
    wrong = [(1 - q, 1 - t) if held(i) else (q, t) for i, (q, t) in enumerate(labels)]
    for model in (lambda d, k: quality.quality_scores(d, k),
                  lambda d, k: toxicity.toxicity_scores(d, k)):
        one = sorted(model(*frames(spark, texts, labels)).collect())
        other = sorted(model(*frames(spark, texts, wrong)).collect())
        assert one == other


@pytest.mark.parametrize("model", ["quality", "toxicity"])
def test_special_rows(spark, corpus, model):
    texts, labels = corpus
    run = quality.quality_scores if model == "quality" else toxicity.toxicity_scores
    odd = texts[:200] + ["", None, texts[0], "bon " * 100_000, "   "]
    docs, known = frames(spark, odd, labels[:200] + [None] * 5)
    docs = docs.union(docs.filter("doc_id < 3")).union(docs.limit(1).selectExpr(
        "null", "text", "score", "y"))
    rows = run(docs, known.union(known.limit(5)).union(known.limit(1).selectExpr(
        "1L", "null", "7"))).collect()
    assert len(rows) == 209 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[200] == by[201] and by[0] == by[202]
    none = run(docs, known.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert run(docs.limit(0), known).count() == 0


def test_ftrl_leaves_unused_weights_at_zero():
    settings = QualitySettings(bits=4, epochs=30)
    rng = np.random.default_rng(0)
    bias = np.int32(16)
    rows = []
    for _ in range(300):
        y = int(rng.integers(2))
        rows.append((y, np.array([y, 2 + rng.integers(14), bias]), np.array([1.0, 0.3, 1.0])))
    w, _ = quality.ftrl(rows, settings)
    assert w[1] > 1 and w[0] < -1 and np.abs(w[2:]).max() < 0.5


def test_machine_margin_is_the_sum_over_pairs():
    settings = toxicity.Settings(bits=4)
    machine = toxicity.Machine(np.arange(16), settings)
    machine.bias, machine.linear = 0.3, np.random.default_rng(1).normal(size=16)
    machine.vectors = np.random.default_rng(2).normal(size=(16, 4))
    terms = np.array([1, 4, 7, 9])
    want = 0.3 + machine.linear[terms].sum() + sum(
        machine.vectors[a] @ machine.vectors[b] for i, a in enumerate(terms) for b in terms[:i])
    got = machine.margins(np.zeros(4, int), terms, 1)[0]
    assert abs(got - want) < 1e-9


def test_terms_that_tell_something_only_beside_another_are_learned():
    insult, group, slur = 1, 2, 3
    rng = np.random.default_rng(6)

    def draw(n):
        rows, y = [], []
        for _ in range(n):
            a, b = rng.random() < 0.3, rng.random() < 0.4
            c = not a and not b and rng.random() < 3 / 7  # so toxic texts are as many with b as without
            terms = [insult] * a + [group] * b + [slur] * c
            rows.append(np.append(terms, 10 + rng.choice(400, 30, False)).astype(np.int64))
            y.append(a and b or c)
        return rows, np.array(y, float)

    settings = toxicity.Settings()
    rows, y = draw(9000)
    with_group = np.array([group in r for r in rows])
    alone = toxicity.likelihood_ratio(np.array([with_group.sum()]), np.array([y[with_group].sum()]),
                                      len(y), y.sum())
    assert alone[0] < settings.association
    machine = toxicity.train(rows, y, settings)
    at = {t: i for i, t in enumerate(machine.known)}
    assert machine.vectors[at[insult]] @ machine.vectors[at[group]] > 0.5
    rows, y = draw(2000)
    known = [np.array([at[t] for t in r if t in at], int) for r in rows]
    margins = machine.margins(np.repeat(np.arange(len(rows)), [len(k) for k in known]),
                              np.concatenate(known), len(rows))
    assert np.mean((margins > 0) == (y == 1)) > 0.97
    assert len(machine.known) < 40


def test_repeated_ids_learn_the_same_in_any_order(spark):
    rng = random.Random(2)
    rows = [(i % 60, " ".join(rng.choices(FILLER, k=30))) for i in range(180)]
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(60)],
                                   "doc_id long, quality int, toxic boolean").selectExpr(
        "doc_id", "quality", "cast(toxic as int) toxic")
    weights = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(seed + 2)
        weights.append(quality.fit(docs, labels))
    assert np.array_equal(*weights)


def plain_ftrl(rows, settings):
    """The same learner one coordinate at a time, without arrays of features."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= settings.l1:
            return 0.0
        shrunk = z[i] - (settings.l1 if z[i] > 0 else -settings.l1)
        return -shrunk / ((settings.beta + n[i] ** 0.5) / settings.alpha + settings.l2)

    order = np.random.default_rng(0)
    for _ in range(settings.epochs):
        for k in order.permutation(len(rows)):
            y, at, x = rows[k]
            w = [weight(i) for i in at]
            p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x))))
            for i, wi, xi in zip(at, w, x):
                g = (p - y) * xi
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - before ** 0.5) / settings.alpha * wi
    return {i: weight(i) for i in z}


def test_ftrl_equals_a_plain_one():
    settings = QualitySettings(bits=5)
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(120):
        at = np.sort(rng.choice(32, rng.integers(1, 12), False))
        y = int(at.min() < 5)
        rows.append((y, np.append(at, 32), np.append(rng.random(len(at)) * 6, 1.0)))
    w, bias = quality.ftrl(rows, settings)
    want = plain_ftrl(rows, settings)
    got = np.append(w, bias)
    assert np.count_nonzero(got) > 10
    assert all(abs(got[i] - want.get(i, 0.0)) < 1e-9 for i in range(33))


def plain_machine(rows, y, known, settings):
    """The factorization machine text by text, with every pair of terms spelled out."""
    k = settings.factors
    vectors = np.random.default_rng(0).normal(0, 0.01, (len(known), k))
    linear, linear_sum = [0.0] * len(known), [1e-8] * len(known)
    vector_sum = np.full((len(known), k), 1e-8)
    share = min(max(y.mean(), 0.01), 0.99)
    bias, bias_sum = float(np.log(share / (1 - share))), 1e-8
    order = np.random.default_rng(1)
    for _ in range(settings.epochs):
        shuffled = order.permutation(len(rows))
        for a in range(0, len(rows), settings.batch):
            picked = shuffled[a:a + settings.batch]
            wrong, before = [], vectors.copy()
            for i in picked:
                margin = bias + sum(linear[t] for t in rows[i])
                for p, s in enumerate(rows[i]):
                    for t in rows[i][:p]:
                        margin += sum(vectors[s][f] * vectors[t][f] for f in range(k))
                wrong.append(1 / (1 + np.exp(-margin)) - y[i])
            for t in sorted({t for i in picked for t in rows[i]}):
                held = [(w, rows[i]) for w, i in zip(wrong, picked) if t in rows[i]]
                g = sum(w for w, _ in held) / len(picked) + settings.l2 * linear[t]
                linear_sum[t] += g * g
                moved = linear[t] - settings.rate * g / linear_sum[t] ** 0.5
                least = settings.rate * settings.l1 / linear_sum[t] ** 0.5
                linear[t] = float(np.sign(moved)) * max(abs(moved) - least, 0.0)
                for f in range(k):
                    gv = sum(w * sum(before[s][f] for s in r if s != t) for w, r in held) / len(
                        picked) + settings.l2 * before[t][f]
                    vector_sum[t][f] += gv * gv
                    vectors[t][f] -= settings.rate * 0.2 * gv / vector_sum[t][f] ** 0.5
            gb = sum(wrong) / len(picked)
            bias_sum += gb * gb
            bias -= settings.rate * gb / bias_sum ** 0.5
    return np.array(linear), vectors, bias


def test_factorization_machine_equals_a_plain_one():
    settings = toxicity.Settings(bits=5, rare=1, association=0.0, epochs=3, batch=16)
    rng = np.random.default_rng(8)
    rows = [np.sort(rng.choice(12, rng.integers(2, 7), False)).astype(np.int64) for _ in range(80)]
    y = np.array([float(1 in r and 2 in r) for r in rows])
    machine = toxicity.train(rows, y, settings)
    at = {t: i for i, t in enumerate(machine.known)}
    linear, vectors, bias = plain_machine([[at[t] for t in r if t in at] for r in rows], y,
                                          machine.known, settings)
    assert len(machine.known) > 5
    assert np.allclose(machine.linear, linear, atol=1e-9) and np.allclose(
        machine.vectors, vectors, atol=1e-9) and abs(machine.bias - bias) < 1e-9
