"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-Proximal.

Features are hashed unigrams and bigrams of words, and n-grams of word shapes (marks, letters, case,
length, repetition of the word before), so that forms seen on few words carry over to all. A
feature's value is its share of the text's n-grams. The score of a text is one sparse dot product.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import words
from tidemark.llm.common import modest_batches, pieces, slices
from tidemark.llm.samples import held_out, labelled

_FEATURES = "doc_id long, y int, at array<int>, value array<float>"


@dataclass(frozen=True)
class Settings:
    """`sample` bounds the labelled rows that one task learns from."""

    bits: int = 18
    sample: int = 6000
    epochs: int = 3
    alpha: float = 0.2
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    scale: float = 30.0


def _shapes(data, starts, ends, hashes, doc) -> np.ndarray:
    upper = np.append(0, np.cumsum((data >= 0x41) & (data <= 0x5A)))
    mark = words.LETTERS_AND_MARKS[data[starts]] == 2
    length = np.minimum(ends - starts, 12)
    capitals = upper[ends] - upper[starts]
    case = np.where(capitals == 0, 0, np.where(capitals == 1, 1, 2))
    again = np.zeros((2, len(hashes)), np.int64)
    for back in (1, 2):
        same = (hashes[back:] == hashes[:-back]) & (doc[back:] == doc[:-back])
        again[back - 1, back:] = same
    return ((((mark * 13 + length) * 3 + case) * 2 + again[0]) * 2 + again[1]).astype(np.uint64)


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every n-gram of a batch, one after another, not yet summed."""
    data, _ = words.buffers(texts)
    docs, found = [], []
    for doc, hashes, starts, ends in words.words(texts, words.LETTERS_AND_MARKS):
        shape = words.mix(_shapes(data, starts, ends, hashes, doc) + np.uint64(11))
        kinds = [hashes, shape]
        for values, n in ((hashes, 2), (shape, 2), (shape, 3)):
            joined = values.copy()
            for k in range(1, n):
                joined = words.mix(joined[:len(values) - k] * np.uint64(5)) + values[k:]
            whole = doc[:len(joined)] == doc[len(doc) - len(joined):]
            docs.append(doc[:len(joined)][whole])
            found.append(joined[whole] * np.uint64(2 * n + 1) + np.uint64(n))
        for k, values in enumerate(kinds):
            docs.append(doc)
            found.append(values + np.uint64(k))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), (words.mix(np.concatenate(found))
                                  >> np.uint64(64 - bits)).astype(np.int64)


def _extract(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << settings.bits
        for batch in slices(batches, "text", 2 << 20):
            doc, feature = features(batch.column("text"), settings.bits)
            total = np.maximum(np.bincount(doc, minlength=batch.num_rows), 1)
            pair, count = np.unique(doc * size + feature, return_counts=True)
            doc, feature = np.divmod(pair, size)
            value = (count * settings.scale / total[doc]).astype(np.float32)
            ends = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=batch.num_rows))),
                            pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("y"),
                pa.ListArray.from_arrays(ends, pa.array(feature, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(value)),
            ], names=["doc_id", "y", "at", "value"])
    return run


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], settings: Settings) -> tuple:
    """Weights and bias from (label, features, values) by per-coordinate FTRL-Proximal."""
    size = (1 << settings.bits) + 1  # the last coordinate is the bias
    z, n = np.zeros(size), np.zeros(size)
    a, b, l1, l2 = settings.alpha, settings.beta, settings.l1, settings.l2

    def weight(z, n):
        return np.where(np.abs(z) <= l1, 0.0,
                        -(z - np.sign(z) * l1) / ((b + np.sqrt(n)) / a + l2))

    random = np.random.default_rng(0)
    for _ in range(settings.epochs):
        for k in random.permutation(len(rows)):
            y, at, x = rows[k]
            w = weight(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / a * w
            n[at] = more
    w = weight(z, n)
    return w[:-1], w[-1]


def _train(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        bias = 1 << settings.bits
        for batch in batches:
            for i in range(batch.num_rows):
                at = batch.column("at")[i].values.to_numpy(zero_copy_only=False)
                x = batch.column("value")[i].values.to_numpy(zero_copy_only=False)
                rows.append((batch.column("y")[i].as_py(), np.append(at, np.int32(bias)),
                             np.append(x, np.float32(1))))
        if not rows:
            return
        w, b = ftrl(rows, settings)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, bias), pa.int32()), pa.array(np.append(w[at], b))],
            names=["at", "weight"])
    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality",
        settings: Settings = Settings()) -> np.ndarray:
    """The weights, with the bias last. One task learns from at most `settings.sample` rows."""
    rows = labelled(docs, labels, label, settings.sample)
    extracted = rows.mapInArrow(_extract(settings), _FEATURES)
    model = (extracted.repartition(1).sortWithinPartitions("doc_id")
             .mapInArrow(_train(settings), "at int, weight double"))
    out = np.zeros((1 << settings.bits) + 1)
    for row in model.toLocalIterator():  # at most as many rows as there are weights
        out[row[0]] = row[1]
    return out


def scores(texts: pa.Array, weights: np.ndarray, settings: Settings) -> np.ndarray:
    out = []
    for part in pieces(texts):
        doc, feature = features(part, settings.bits)
        total = np.maximum(np.bincount(doc, minlength=len(part)), 1)
        dot = np.bincount(doc, weights=weights[feature], minlength=len(part))
        out.append(dot * settings.scale / total)
    dot = np.concatenate(out) if out else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(dot + weights[-1], -35, 35)))


def _score(weights, settings: Settings, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text"))
            names = batch.schema.names + [column]
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array(scores(texts, weights, settings))], names=names)
    return run


def with_quality(docs: DataFrame, labels: DataFrame, label: str = "quality",
                 column: str = "score", settings: Settings = Settings()) -> DataFrame:
    """All rows and columns of `docs` with the probability of label 1 as `column`.

    Reads `doc_id` and `text` of `docs`, `doc_id` and `label` of `labels`. Labels other than 0 and 1
    and rows held out (see `samples.held_out`) are not learned from; of several labels of a document
    the largest counts. Only the text makes the score. A null or empty text scores by the bias
    alone. Without labelled rows every score is 0.5. A column named like `column` is replaced. An
    empty table gives an empty table; repeated rows and null ids are scored like any row.
    """
    modest_batches(docs.sparkSession)
    docs = docs.drop(column)
    weights = fit(docs, labels, label, settings)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(_score(weights, settings, column), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from `threshold` on) of every document."""
    return (with_quality(docs.select("doc_id", "text"), labels)
            .select("doc_id", held_out().alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
