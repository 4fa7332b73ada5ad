"""Benchmark decontamination: BM25 retrieval of test items for every training passage.

The test items form an inverted index with BM25 impacts and, per term, the largest impact in each
block of items. Every document is cut into overlapping passages, and every passage is a query. An
item is retrieved if the passage's terms reach a share of the score the item gives itself, so one
threshold holds for short and long items. Block maxima summed over a passage's terms bound its
score with any item of a block. Bounds over coarse blocks are summed for every passage, those over
fine blocks for the passages that are left; in the blocks whose bounds reach the threshold, block-max
WAND finds the items. Retrieved items are verified by the share of the word n-grams of their
question and of their answer that the passage holds.

An index covers a bounded number of items and goes to every task; larger benchmarks go through in
several passes over the documents. Document frequencies and the average length are those of the whole
benchmark, so an item scores alike in whichever index it is.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.common import free_name, keep, modest_batches, slices

#: An index holds at most this many items and characters of text.
MAX_ITEMS, MAX_CHARS = 4000, 4_000_000
#: Coarse blocks of an index, and items of a fine block.
BLOCKS, BLOCK_ITEMS = 32, 2

#: Words for retrieval and verification: letters, digits and bytes beyond ASCII, without marks.
WORDS_ONLY = np.where(words.LETTERS_AND_MARKS == 1, 1, 0).astype(np.uint8)

_PAIRS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double"


@dataclass(frozen=True)
class Limits:
    """`share` of an item's own score retrieves it. It is verified by `overlap` of the n-grams of
    both question and answer, or by `whole` of all its n-grams."""

    share: float = 0.5
    overlap: float = 0.5
    whole: float = 0.8
    ngram: int = 5
    min_passage: int = 64


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's answer is its last line, or else its last sentence; one sentence has none."""
    text = text.strip()
    lines = text.rsplit("\n", 1)
    if len(lines) == 2:
        return lines[0], lines[1]
    cut = [m.end() for m in re.finditer(r"[.?!]\s+", text)]
    return (text[:cut[-1]], text[cut[-1]:]) if cut else (text, "")


def _hashes(texts: list[str]) -> list[np.ndarray]:
    doc, found, _, _ = words.all_words(pa.array(texts, pa.string()), WORDS_ONLY)
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [found[a:b] for a, b in zip(edges[:-1], edges[1:])]


def _part(hashes: np.ndarray, n: int) -> tuple[int, np.ndarray]:
    """The n-grams of a part of an item and their size: a shorter part is one n-gram of its own."""
    size = min(n, len(hashes))
    return size, np.unique(words.shingles(np.zeros(len(hashes), np.int64), hashes, size, False)[1])


@dataclass(frozen=True)
class Corpus:
    """Of a whole benchmark: its items with words, their average length, and in how many of them each
    of some terms occurs. Terms are in order."""

    items: int
    average: float
    terms: np.ndarray
    counts: np.ndarray


class Index:
    """Inverted index of items with BM25 impacts as shares of each item's own score. Without `corpus`
    the items are the whole benchmark."""

    def __init__(self, items: list[tuple[int, str]], limits: Limits, k1: float = 1.2,
                 b: float = 0.75, corpus: Corpus | None = None):
        self.limits = limits
        parts = [question_and_answer(text) for _, text in items]
        tokens = _hashes([text for _, text in items])
        # Items of like length share blocks, which keeps the block maxima tight.
        order = sorted((i for i in range(len(items)) if len(tokens[i])),
                       key=lambda i: (len(tokens[i]), i))
        self.ids = [items[i][0] for i in order]
        tokens = [tokens[i] for i in order]
        self.size = len(order)
        coarse = BLOCK_ITEMS * max(1, -(-self.size // (BLOCKS * BLOCK_ITEMS)))
        self.coarse = -(-self.size // coarse)
        self.fine = -(-self.size // BLOCK_ITEMS)
        self.passage = max([limits.min_passage, *(2 * len(t) for t in tokens)])
        self.terms = np.unique(np.concatenate(tokens)) if tokens else np.zeros(0, np.uint64)
        n = max(1, self.size)
        average = sum(map(len, tokens)) / n
        counted = [np.unique(np.searchsorted(self.terms, t), return_counts=True) for t in tokens]
        df = np.bincount(np.concatenate([t for t, _ in counted]) if counted else [],
                         minlength=len(self.terms))
        whole = self.size
        if corpus is not None:
            whole, average = corpus.items, corpus.average
            df = corpus.counts[np.searchsorted(corpus.terms, self.terms)]
        idf = np.log1p((whole - df + 0.5) / (df + 0.5))
        postings: list[list] = [[] for _ in self.terms]
        self.maxima = np.zeros((len(self.terms), self.coarse), np.float32)
        for i, (terms, tf) in enumerate(counted):
            impact = idf[terms] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(tokens[i]) / average))
            impact /= impact.sum()
            for t, x in zip(terms, impact):
                postings[t].append((i, float(x)))
            rows = self.maxima[terms, i // coarse]
            self.maxima[terms, i // coarse] = np.maximum(rows, impact)
        self.postings = [([i for i, _ in p], [x for _, x in p]) for p in postings]
        self.upper = [max(x) for _, x in self.postings]
        self.in_block: list[dict[int, float]] = []
        for who, impacts in self.postings:
            most: dict[int, float] = {}
            for i, x in zip(who, impacts):
                most[i // BLOCK_ITEMS] = max(x, most.get(i // BLOCK_ITEMS, 0.0))
            self.in_block.append(most)
        # The same block maxima as arrays, term after term.
        self.block_ends = np.append(0, np.cumsum([len(b) for b in self.in_block])).astype(np.int64)
        self.block_of = np.array([b for m in self.in_block for b in m], np.int64)
        self.block_max = np.array([x for m in self.in_block for x in m.values()])
        texts = _hashes([x for i in order for x in parts[i]])
        self.parts = [[_part(x, limits.ngram) for x in item]
                      for item in zip(texts[::2], texts[1::2], tokens)]

    def block_bounds(self, passage: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Bounds of `n` passages, given their distinct terms, with the items of each fine block."""
        sizes = self.block_ends[term + 1] - self.block_ends[term]
        who = np.repeat(passage, sizes)
        at = np.arange(len(who)) + np.repeat(
            self.block_ends[term] - np.append(0, np.cumsum(sizes)[:-1]), sizes)
        sums = np.bincount(who * self.fine + self.block_of[at], weights=self.block_max[at],
                           minlength=n * self.fine)
        return sums.reshape(n, self.fine)

    def retrieve(self, terms, blocks=None) -> list[tuple[int, float]]:
        """Items whose score with distinct terms reaches the share, by block-max WAND. With `blocks`,
        only items in these fine blocks, in ascending order, are looked at."""
        share = self.limits.share - 1e-9
        blocks = range(self.fine) if blocks is None else blocks
        lists = [(self.postings[t], self.upper[t], self.in_block[t]) for t in map(int, terms)]
        cursors = [0] * len(lists)
        out = []
        while True:
            heads = sorted((lists[c][0][0][at], c) for c, at in enumerate(cursors)
                           if at < len(lists[c][0][0]))
            bound, pivot = 0.0, None
            for item, c in heads:
                bound += lists[c][1]
                if bound >= share:
                    pivot = item
                    break
            if pivot is None:
                return out
            block = pivot // BLOCK_ITEMS
            wanted = bisect_left(blocks, block)
            if wanted == len(blocks):
                return out
            near = [c for item, c in heads if item <= pivot]
            if blocks[wanted] != block:
                near, target = [c for _, c in heads], blocks[wanted] * BLOCK_ITEMS
            elif sum(lists[c][2].get(block, 0.0) for c in near) < share:
                # No item up to the block's end, or the next head, can reach it.
                target = min([(block + 1) * BLOCK_ITEMS,
                              *(item for item, _ in heads[len(near):])])
            elif heads[0][0] == pivot:
                score = sum(lists[c][0][1][cursors[c]] for item, c in heads if item == pivot)
                if score >= share:
                    out.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for c in near:
                cursors[c] = bisect_left(lists[c][0][0], target, cursors[c])

    def overlaps(self, item: int, passage: np.ndarray) -> tuple[float, float, float]:
        """Shares of the n-grams of question, answer and all that a passage's words hold."""
        doc = np.zeros(len(passage), np.int64)

        def share(size, grams):
            if not size:
                return 1.0
            held = words.shingles(doc, passage, size, False)[1]
            return float(np.isin(grams, held).mean())

        return tuple(share(*part) for part in self.parts[item])


def build_index(items: list[tuple[int, str]], limits: Limits, corpus: Corpus | None = None) -> Index:
    return Index(items, limits, corpus=corpus)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = _hashes(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(t) for t in tokens], pa.int64()),
             pa.array([np.unique(t).view(np.int64) for t in tokens], pa.list_(pa.int64()))],
            names=["length", "terms"])


class _Statistics:
    """The statistics of a whole benchmark, counted by Spark; an index asks for its own terms."""

    def __init__(self, texts: DataFrame):
        self.spark = texts.sparkSession
        found = keep(texts.mapInArrow(_item_terms, "length long, terms array<long>"))
        self.items, total = found.filter("length > 0").agg(F.count("*"), F.sum("length")).first()
        self.average = (total or 0) / max(1, self.items)
        self.counts = keep(found.select(F.explode("terms").alias("term")).groupBy("term").agg(
            F.count("*").alias("n")))

    def of(self, items: list[tuple[int, str]]) -> Corpus:
        tokens = _hashes([text for _, text in items])
        terms = np.unique(np.concatenate(tokens)) if tokens else np.zeros(0, np.uint64)
        # At most the distinct words of MAX_CHARS characters.
        asked = self.spark.createDataFrame(pd.DataFrame({"term": terms.view(np.int64)}), "term long")
        known = self.counts.join(asked, "term").toPandas()
        order = np.argsort(known["term"].to_numpy().view(np.uint64))
        return Corpus(self.items, self.average, terms, known["n"].to_numpy()[order])


def _passages(index: Index, doc: np.ndarray, hashes: np.ndarray):
    """(text number, first word, end word, terms, fine blocks) of the passages whose bounds reach the
    share in some blocks.

    A passage is two neighbouring halves of a text, so each run of words up to half a passage long
    lies in one passage as a whole.
    """
    half = index.passage // 2
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    within = np.arange(len(doc)) - np.repeat(starts, np.diff(np.append(starts, len(doc))))
    edges = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (within[1:] % half == 0)))
    ends = np.append(edges[1:], len(doc))
    size = len(index.terms)
    term = np.searchsorted(index.terms, hashes)
    term[term == size] = 0
    hit = np.flatnonzero(index.terms[term] == hashes)
    pairs = words.distinct((np.searchsorted(edges, hit, "right") - 1) * size + term[hit])
    piece_of, term_of = np.divmod(pairs, size)
    bounds = np.zeros((len(edges), index.coarse), np.float32)
    for a in range(0, len(pairs), 1 << 16):
        who = piece_of[a:a + (1 << 16)]
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        bounds[who[first]] += np.add.reduceat(index.maxima[term_of[a:a + (1 << 16)]], first)
    joined = np.append(doc[edges[1:]] == doc[edges[:-1]], False)
    bounds[:-1][joined[:-1]] += bounds[1:][joined[:-1]]
    # A last half is part of the passage before it, unless it is a text's only one.
    only = ~joined & ~np.append(False, joined[:-1])
    share = index.limits.share
    wanted = np.flatnonzero((bounds.max(1) >= share - 1e-4) & (joined | only))
    first_pair = np.searchsorted(piece_of, np.arange(len(edges) + 1))
    for a in range(0, len(wanted), 2048):
        part = wanted[a:a + 2048]
        last = part + joined[part]
        low, high = first_pair[part], first_pair[last + 1]
        who = np.repeat(np.arange(len(part)), high - low)
        at = np.arange(len(who)) + np.repeat(low - np.append(0, np.cumsum(high - low)[:-1]),
                                             high - low)
        distinct = words.distinct(who * size + term_of[at])
        who, terms = np.divmod(distinct, size)
        fine = index.block_bounds(who, terms, len(part)) >= share - 1e-9
        for i in np.flatnonzero(fine.any(1)):
            yield (int(doc[edges[part[i]]]), int(edges[part[i]]), int(ends[last[i]]),
                   terms[np.searchsorted(who, i):np.searchsorted(who, i, "right")],
                   np.flatnonzero(fine[i]).tolist())


def search(index: Index, texts: pa.Array) -> dict[tuple[int, int], tuple]:
    """Verified items of a batch of texts: (text number, item) -> score and overlaps."""
    found: dict[tuple[int, int], tuple] = {}
    if not index.size:
        return found
    doc, hashes, _, _ = words.all_words(texts, WORDS_ONLY)
    if not len(doc):
        return found
    limits = index.limits
    for text, a, b, terms, blocks in _passages(index, doc, hashes):
        passage = hashes[a:b]
        for item, score in index.retrieve(terms, blocks):
            question, answer, whole = index.overlaps(item, passage)
            if min(question, answer) >= limits.overlap or whole >= limits.whole:
                best = found.get((text, item))
                if best is None or (whole, score) > (best[3], best[0]):
                    found[text, item] = (score, question, answer, whole)
    return found


def _scan(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = search(index, batch.column(1))
            ids = batch.column(0)
            rows = [(ids[text].as_py(), index.ids[item], *figures)
                    for (text, item), figures in sorted(found.items())]
            kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)],
                names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap",
                       "overlap"])
    return run


def _indexes(benchmark: DataFrame, limits: Limits) -> Iterator[Index]:
    rows = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.lower(F.col("text").cast("string")).alias("text")).filter(
        F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    statistics = None
    items, chars = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if items and (len(items) >= MAX_ITEMS or chars + len(row[1]) > MAX_CHARS):
            statistics = statistics or _Statistics(rows.select("text"))
            yield build_index(items, limits, statistics.of(items))
            items, chars = [], 0
        items.append((row[0], row[1]))
        chars += len(row[1])
    yield build_index(items, limits, statistics.of(items) if statistics else None)


def find_leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Benchmark items that documents contain: doc_id, item_id, score (share of the item's own BM25
    score), and the shares of the n-grams of its question, its answer and all of it.

    Reads `doc_id`, `text` of `docs` and `item_id`, `text` of `benchmark`; other columns are
    ignored. Words are runs of letters and digits in lower case. A document has a row per item, with
    its best passage. Null and empty texts and items without words or id match nothing. A repeated
    document row has rows of its own; a null doc_id gives rows with a null doc_id. Items that share
    an id are separate items, whose rows share the id. A question without an answer counts its answer
    as held. Texts may have any length. Empty tables give an empty table.
    """
    modest_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.lower(F.col("text").cast("string")).alias("text"))
    out = None
    for index in _indexes(benchmark, limits):
        found = texts.mapInArrow(_scan(index), _PAIRS)
        out = found if out is None else out.union(found)
    return out


def _clean(index, lower: str):
    """Keep the rows of a batch that match no item; the column `lower` goes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, lower):
            where = batch.schema.get_field_index(lower)
            bad = np.zeros(batch.num_rows, bool)
            bad[[text for text, _ in search(index, batch.column(where))]] = True
            yield batch.filter(pa.array(~bad)).select(
                [f.name for i, f in enumerate(batch.schema) if i != where])
    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of `docs` that contain no benchmark item, with all their columns.

    Works like `find_leaks`, in the same pass over the texts, so no join is needed and repeated or
    null ids do not matter.
    """
    modest_batches(docs.sparkSession)
    schema = docs.schema
    lower = free_name("_lower", docs.columns)
    for index in _indexes(benchmark, limits):
        docs = docs.withColumn(lower, F.lower(F.col("text"))).mapInArrow(
            _clean(index, lower), schema)
    return docs
