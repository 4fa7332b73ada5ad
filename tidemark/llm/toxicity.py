"""Toxicity: a factorization machine over hashed terms.

Besides a weight per term, every term has a short vector, and the product of two terms' vectors is
the weight of seeing both. So an insult beside a mention of a group scores above the sum of the two.
Terms are the words of a text and their first letters, each counted once however long the text is.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import words
from tidemark.llm.common import slices
from tidemark.llm.samples import held_out, labelled

WORDS_ONLY = np.where(words.LETTERS_AND_MARKS == 1, 1, 0).astype(np.uint8)
_FEATURES = "doc_id long, y int, at array<int>"


@dataclass(frozen=True)
class Settings:
    """`sample` bounds the labelled rows that one task learns from. Terms in fewer than `rare` of
    them, or whose log-likelihood ratio with the label is below `association`, both alone and beside
    a term that reaches it alone, keep no weights (see `telling`)."""

    bits: int = 20
    sample: int = 12000
    factors: int = 4
    rare: int = 8
    epochs: int = 8
    batch: int = 64
    rate: float = 0.15
    l1: float = 5e-4
    association: float = 10.0
    l2: float = 2e-4
    prefix: int = 4


def terms(texts: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) of every word and word beginning of a batch, with repetitions."""
    data, _ = words.buffers(texts)
    docs, found = [], []
    for doc, hashes, starts, ends in words.words(texts, WORDS_ONLY):
        long = np.flatnonzero(ends - starts > settings.prefix)
        first = np.zeros(len(long), np.uint64)
        for k in range(settings.prefix):
            first = first << np.uint64(8) | words.LOWER[data[starts[long] + k]].astype(np.uint64)
        docs += [doc, doc[long]]
        found += [hashes, words.mix(first + np.uint64(97))]
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), (np.concatenate(found)
                                  >> np.uint64(64 - settings.bits)).astype(np.int64)


def _distinct(doc: np.ndarray, term: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    pair = words.distinct(doc << bits | term)
    return pair >> bits, pair & ((1 << bits) - 1)


def _extract(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            doc, term = _distinct(*terms(batch.column("text"), settings), settings.bits)
            ends = np.append(0, np.cumsum(np.bincount(doc, minlength=batch.num_rows)))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("y"),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(term, pa.int32())),
            ], names=["doc_id", "y", "at"])
    return run


class Machine:
    """A factorization machine over the terms it knows; terms it doesn't know count nothing."""

    def __init__(self, known: np.ndarray, settings: Settings):
        self.known = known
        self.bias = 0.0
        self.linear = np.zeros(len(known))
        self.vectors = np.random.default_rng(0).normal(0, 0.01, (len(known), settings.factors))

    def margins(self, doc: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Before the sigmoid; `term` counts into `known`, distinct per text."""
        out = self.bias + np.bincount(doc, weights=self.linear[term], minlength=rows)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[term, f]
            total = np.bincount(doc, weights=v, minlength=rows)
            out += (total * total - np.bincount(doc, weights=v * v, minlength=rows)) / 2
        return out


def likelihood_ratio(n: np.ndarray, k: np.ndarray, rows: int, ones: float) -> np.ndarray:
    """How much better two rates explain the labels of rows with and without a term than one."""
    def fit(hits, size):
        with np.errstate(divide="ignore", invalid="ignore"):
            p = hits / size
            value = hits * np.log(p) + (size - hits) * np.log1p(-p)
        return np.nan_to_num(value, nan=0.0, posinf=0.0, neginf=0.0)

    return 2 * (fit(k, n) + fit(ones - k, rows - n) - fit(np.float64(ones), rows))


def telling(rows: list[np.ndarray], y: np.ndarray, settings: Settings) -> np.ndarray:
    """The terms, in ascending order, that tell something alone, or in the rows of a term that does.

    Every term that does makes for another test of all terms, so the ratio asked for beside one grows with
    their number, twice its logarithm, which keeps chance hits as few as those of terms alone.
    """
    every = np.concatenate(rows)
    counts = np.bincount(every, minlength=1 << settings.bits)
    often = np.flatnonzero(counts >= settings.rare)
    place = np.full(1 << settings.bits, -1)
    place[often] = np.arange(len(often))
    rows = [x[x >= 0] for x in (place[r] for r in rows)]
    every = np.concatenate(rows)
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    row_of = row_of[np.argsort(every, kind="stable")]
    ends = np.append(0, np.cumsum(counts[often]))

    def ratios(held: np.ndarray) -> np.ndarray:
        def seen(which):
            found = [rows[i] for i in which]
            return np.bincount(np.concatenate(found) if found else [], minlength=len(often))

        toxic = seen(held[y[held] == 1])
        n = toxic + seen(held[y[held] != 1])
        return np.where(n >= settings.rare,
                        likelihood_ratio(n, toxic, len(held), y[held].sum()), 0)

    known = ratios(np.arange(len(rows))) >= settings.association
    partners = np.flatnonzero(known)
    best = np.zeros(len(often))
    for k in partners:
        held = row_of[ends[k]:ends[k + 1]]
        if 0 < y[held].sum() < len(held):
            best = np.maximum(best, ratios(held))
    known |= best >= settings.association + 2 * np.log(max(1, len(partners)))
    return often[known]


def train(rows: list[np.ndarray], y: np.ndarray, settings: Settings) -> Machine:
    """Fit by AdaGrad on small batches. Text lists must hold distinct terms."""
    known = telling(rows, y, settings)
    machine = Machine(known, settings)
    lookup = np.full(1 << settings.bits, -1)
    lookup[known] = np.arange(len(known))
    rows = [x[x >= 0] for x in (lookup[r] for r in rows)]
    share = np.clip(y.mean(), 0.01, 0.99)
    machine.bias = float(np.log(share / (1 - share)))
    linear_sum = np.full(len(known), 1e-8)
    vector_sum = np.full(machine.vectors.shape, 1e-8)
    bias_sum = 1e-8
    random = np.random.default_rng(1)
    for _ in range(settings.epochs):
        order = random.permutation(len(rows))
        for a in range(0, len(order), settings.batch):
            picked = order[a:a + settings.batch]
            sizes = np.array([len(rows[i]) for i in picked])
            term = np.concatenate([rows[i] for i in picked])
            doc = np.repeat(np.arange(len(picked)), sizes)
            margin = machine.margins(doc, term, len(picked))
            wrong = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) - y[picked]
            per = wrong[doc] / len(picked)
            seen, index = np.unique(term, return_inverse=True)
            g = np.bincount(index, weights=per) + settings.l2 * machine.linear[seen]
            linear_sum[seen] += g * g
            steps = settings.rate * g / np.sqrt(linear_sum[seen])
            for f in range(settings.factors):
                v = machine.vectors[term, f]
                total = np.bincount(doc, weights=v, minlength=len(picked))
                gv = (np.bincount(index, weights=per * (total[doc] - v))
                      + settings.l2 * machine.vectors[seen, f])
                vector_sum[seen, f] += gv * gv
                machine.vectors[seen, f] -= settings.rate * 0.2 * gv / np.sqrt(vector_sum[seen, f])
            moved = machine.linear[seen] - steps
            # A proximal step keeps the weights of terms that tell nothing at 0.
            least = settings.rate * settings.l1 / np.sqrt(linear_sum[seen])
            machine.linear[seen] = np.sign(moved) * np.maximum(np.abs(moved) - least, 0)
            gb = wrong.mean()
            bias_sum += gb * gb
            machine.bias -= settings.rate * gb / np.sqrt(bias_sum)
    return machine


def _train(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for batch in batches:
            y += batch.column("y").to_pylist()
            rows += [x.values.to_numpy(zero_copy_only=False) for x in batch.column("at")]
        if not rows:
            return
        machine = train(rows, np.array(y, float), settings)
        weights = np.column_stack([machine.linear, machine.vectors])
        weights = np.vstack([weights, [machine.bias, *[0] * settings.factors]])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.append(machine.known, -1), pa.int32()),
            pa.FixedSizeListArray.from_arrays(pa.array(weights.ravel()), settings.factors + 1)
            .cast(pa.list_(pa.float64()))], names=["at", "weights"])
    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic",
        settings: Settings = Settings()) -> Machine:
    """One task learns from at most `settings.sample` rows; its weights come to the driver, at most
    `factors + 1` for each of 2**bits terms."""
    rows = labelled(docs, labels, label, settings.sample)
    extracted = rows.mapInArrow(_extract(settings), _FEATURES)
    model = (extracted.repartition(1).sortWithinPartitions("doc_id")
             .mapInArrow(_train(settings), "at int, weights array<double>"))
    known, weights, bias = [], [], 0.0
    for at, values in model.toLocalIterator():
        if at < 0:
            bias = values[0]
        else:
            known.append(at)
            weights.append(values)
    machine = Machine(np.array(known, np.int64), settings)
    machine.bias = bias
    if known:
        weights = np.array(weights)
        machine.linear, machine.vectors = weights[:, 0].copy(), weights[:, 1:].copy()
    return machine


def scores(texts: pa.Array, machine: Machine, settings: Settings) -> np.ndarray:
    rows = len(texts)
    doc, term = terms(texts, settings)
    lookup = np.full(1 << settings.bits, -1, np.int32)
    lookup[machine.known] = np.arange(len(machine.known))
    term = lookup[term]
    doc, term = doc[term >= 0], term[term >= 0].astype(np.int64)
    doc, term = _distinct(doc, term, settings.bits)
    return 1 / (1 + np.exp(-np.clip(machine.margins(doc, term, rows), -35, 35)))


def _score(machine, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores(batch.column(1), machine, settings))],
                names=["doc_id", "score"])
    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3,
                    settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted (1 from `threshold` on).

    Reads `doc_id` and `text` of `docs`, `doc_id` and `toxic` of `labels`; other columns are
    ignored. Labels other than 0 and 1 and rows held out (see `samples.held_out`) are not learned
    from; of several labels of a document the largest counts. Only the text makes the score. A null
    or empty text and a text of unknown terms score by the bias alone; without labelled rows that is
    0.5. A row per input row, repeated rows and null ids included; an empty table gives an empty
    table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    machine = fit(docs, labels, "toxic", settings)
    scored = docs.mapInArrow(_score(machine, settings), T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
