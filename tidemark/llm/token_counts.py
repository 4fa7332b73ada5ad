"""Token counts of byte-level BPE vocabularies by rank-synchronous merging of ragged arrays.

A batch's distinct pre-tokens lie behind one another in one array of symbol numbers. In every round
each sequence finds the lowest rank among its neighbouring pairs, and all sequences merge that pair
at once; a sequence leaves when no pair of it has a rank. What counts are the symbols that survive.
"""

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

#: Fixed value: how byte-level BPE vocabularies of this family split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Code points that `regex` knows as letters or numbers, but the tables of the
#: library's pre-tokenizer do not yet; there they are neither.
UNKNOWN = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC),
    (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)

#: Distinct pre-tokens whose counts a task remembers between batches.
REMEMBERED = 500_000
SYMBOLS_AT_ONCE = 1 << 20

_NO_RANK = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, by its rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge table of a vocabulary file as sorted arrays."""

    def __init__(self, content: str):
        file = json.loads(content)
        model, split = file["model"], file["pre_tokenizer"]
        if (model["type"], split["type"], split["add_prefix_space"], split["use_regex"],
                model["ignore_merges"], file["normalizer"]) != (
                "BPE", "ByteLevel", False, True, False, None):
            raise ValueError("not a byte-level BPE vocabulary of the supported kind")
        self.specials = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        vocabulary = model["vocab"]
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.of_byte[byte] = vocabulary[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs), dtype=np.int32)
        # A merge of all places at once equals merging one place after another, unless the new
        # symbol could at once be part of a lower rank. Such pairs merge one place a round.
        least = np.full(max(vocabulary.values()) + 1, _NO_RANK, np.int64)
        np.minimum.at(least, left, rank)
        np.minimum.at(least, right, rank)
        order = np.argsort(left << 32 | right, kind="stable")
        self.key = (left << 32 | right)[order]
        self.rank = rank[order]
        self.made = made
        self.single = least[made] < rank

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.rank[at], _NO_RANK)

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Surviving symbols of each byte sequence."""
        sizes = np.array([len(s) for s in sequences], np.int64)
        counts = sizes.copy()
        symbol = self.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), sizes)
        pair = self.ranks(symbol[:-1], symbol[1:])
        pair[owner[:-1] != owner[1:]] = _NO_RANK
        pair = np.append(pair, _NO_RANK)[:len(symbol)]
        while len(symbol):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(pair, starts)
            lengths = np.diff(np.append(starts, len(symbol)))
            alive = lowest < _NO_RANK
            counts[owner[starts[~alive]]] = lengths[~alive]
            if not alive.any():
                break
            stay = np.repeat(alive, lengths)
            wanted = np.repeat(lowest[alive], lengths[alive])
            symbol, owner, pair = symbol[stay], owner[stay], pair[stay]
            places = np.flatnonzero(pair == wanted)
            # Of places that overlap (a run of one symbol), every second one merges, from the left.
            run = np.append(True, places[1:] != places[:-1] + 1)
            start_of_run = places[np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))]
            take = (places - start_of_run) % 2 == 0
            if self.single[wanted[places]].any():
                first = np.append(True, owner[places[1:]] != owner[places[:-1]])
                take &= first | ~self.single[wanted[places]]
            places = places[take]
            symbol[places] = self.made[wanted[places]]
            keep = np.ones(len(symbol), bool)
            keep[places + 1] = False
            # Only pairs with a new symbol have new ranks.
            touched = np.zeros(len(symbol), bool)
            touched[places] = True
            touched[places[places > 0] - 1] = True
            before = places - 2
            touched[before[(before >= 0) & ~keep[np.maximum(before + 1, 0)]]] = True
            symbol, owner, pair, touched = symbol[keep], owner[keep], pair[keep], touched[keep]
            at = np.flatnonzero(touched)
            inner = at[at + 1 < len(symbol)]
            fresh = self.ranks(symbol[inner], symbol[inner + 1])
            fresh[owner[inner] != owner[inner + 1]] = _NO_RANK
            pair[at] = _NO_RANK
            pair[inner] = fresh
        return counts


class Counter:
    """Counts the tokens of texts, remembering a bounded number of distinct pre-tokens."""

    def __init__(self, merges: Merges):
        self.merges, self.known = merges, {}
        self.pattern = regex.compile(SPLIT)
        self.unknown = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNKNOWN) + "]")
        self.special = (regex.compile("|".join(map(regex.escape, merges.specials)))
                        if merges.specials else None)

    def split(self, text: str) -> list[str]:
        if text.isascii() or self.unknown.search(text) is None:
            return self.pattern.findall(text)
        # U+E000 is neither letter nor number nor space; only the places of the cuts are taken.
        shown = self.unknown.sub("\ue000", text)
        return [text[m.start():m.end()] for m in self.pattern.finditer(shown)]

    def _learn(self, pieces: list[str]) -> None:
        # Sequences of like length leave in like rounds, and keep the arrays in bounds.
        encoded = sorted(((p.encode(), p) for p in pieces), key=lambda x: len(x[0]))
        at = 0
        while at < len(encoded):
            end, size = at, 0
            while end < len(encoded) and (end == at or size + len(encoded[end][0])
                                          <= SYMBOLS_AT_ONCE):
                size += len(encoded[end][0])
                end += 1
            counts = self.merges.count([b for b, _ in encoded[at:end]])
            self.known.update(zip((p for _, p in encoded[at:end]), counts.tolist()))
            at = end

    def counts(self, texts: list[str]) -> list[int]:
        split, extra = [], []
        for text in texts:
            specials = 0
            parts = [text]
            if self.special is not None and any(s in text for s in self.merges.specials):
                specials = len(self.special.findall(text))
                parts = self.special.split(text)
            pieces: list[str] = []
            for part in parts:
                pieces += self.split(part)
            split.append(pieces)
            extra.append(specials)
        new = set().union(*split).difference(self.known) if split else set()
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set().union(*split)
        if new:
            self._learn(list(new))
        known = self.known
        return [sum(map(known.__getitem__, pieces)) + n for pieces, n in zip(split, extra)]


def _count(merges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merges)
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column(1).fill_null("")
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([len(t) for t in texts.cast(pa.binary()).to_pylist()], pa.int64()),
                pa.array(counter.counts(texts.to_pylist()), pa.int64()),
            ], names=["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every whole text.

    `vocabulary` is the path, on the driver, of a `.json` file of a byte-level BPE vocabulary. No
    begin, end or added tokens count; a special token's own string inside a text is that one token.
    Reads `doc_id` and `text`; other columns are ignored. A null text counts as empty, with no
    tokens. A row per input row; a null doc_id stays null, repeated rows are all returned. An empty
    table gives an empty table. Texts are never cut; a pre-token of any length is one sequence.
    """
    with open(vocabulary, encoding="utf-8") as file:
        merges = Merges(file.read())
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
            .mapInArrow(_count(merges), "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
