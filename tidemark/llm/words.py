"""Word splitting and word hashing on whole Arrow batches, shared by the operators on word n-grams.

A batch's texts are handled as one run of UTF-8 bytes. Word borders come from a table of byte
classes, and the 64-bit hash of every word from running sums, so that no Python code runs per word.
Chunks of bounded size keep the arrays small whatever the length of a text.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: Everything between white space is a word: ``[^\x20\x09-\x0D]+``.
PLAIN = np.ones(256, np.uint8)
PLAIN[list(SPACES)] = 0

#: Runs of letters, digits and bytes beyond ASCII are words (1), other visible runs are marks (2).
LETTERS_AND_MARKS = np.where(PLAIN == 0, 0, 2).astype(np.uint8)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A), (0x80, 0xFF)):
    LETTERS_AND_MARKS[_low:_high + 1] = 1

#: Lower-casing of A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the base and of its inverse, made once per process."""

    up = down = None

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up is None or len(cls.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            cls.up, cls.down = _powers(_BASE, n), _powers(inverse, n)
        return cls.up, cls.down


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array and the offsets of the texts; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, size: int) -> list[int]:
    """Byte positions that cut the data into chunks without cutting a word."""
    cuts, at = [0], 0
    while at < len(data):
        at = min(at + size, len(data))
        while at < len(data):
            window = data[at:at + size]
            space = np.flatnonzero(classes[window] == 0)
            text = offsets[np.searchsorted(offsets, at)]
            at = min(at + (int(space[0]) if len(space) else len(window)), int(text))
            if len(space) or at == text:
                break
        cuts.append(at)
    return cuts


def words(texts: pa.Array, classes: np.ndarray = PLAIN,
          size: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """Chunks of (text number, hash of the lower-cased word, first byte, end byte), in order.

    The hash covers the bytes and the length of a word. Bytes count from the start of the batch.
    """
    data, offsets = buffers(texts)
    cuts = _cuts(data, offsets, classes, size)
    for a, b in zip(cuts, cuts[1:]):
        part = data[a:b]
        kind = classes[part]
        first = np.empty(len(part), bool)
        first[0] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        inner = offsets[np.searchsorted(offsets, a, "right"):np.searchsorted(offsets, b, "left")]
        first[inner[inner < b] - a] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(part))
        keep = kind[starts] != 0
        starts, ends = starts[keep], ends[keep]
        up, down = _Tables.get(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[LOWER[part]] * up[:len(part)], out=total[1:])
        value = (total[ends] - total[starts]) * down[starts]
        hashes = mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        yield np.searchsorted(offsets, starts + a, "right") - 1, hashes, starts + a, ends + a


def all_words(texts: pa.Array, classes: np.ndarray = PLAIN) -> tuple[np.ndarray, ...]:
    """The chunks of `words` joined: for operators that need a whole batch's words at once."""
    parts = list(words(texts, classes))
    if not parts:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64),
                np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def shingles(doc: np.ndarray, hashes: np.ndarray, n: int,
             short_whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `n` words in a row within a text, with the text numbers.

    With `short_whole` a text of fewer words gives one shingle of all its words.
    """
    if not len(doc):
        return doc, hashes
    rolled = hashes.copy()
    for k in range(1, n):
        rolled[:-k or None] = mix(rolled[:-k or None] * np.uint64(3)) + hashes[k:] if k < len(
            hashes) else rolled[:0]
    complete = np.zeros(len(doc), bool)
    if len(doc) >= n:
        complete[:len(doc) - n + 1] = doc[:len(doc) - n + 1] == doc[n - 1:]
    out_doc, out = doc[complete], rolled[complete]
    if short_whole and n > 1:
        starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        counts = np.diff(np.append(starts, len(doc)))
        short = starts[counts < n]
        if len(short):
            size = counts[counts < n]
            value = hashes[short].copy()
            for k in range(1, n - 1):
                more = size > k
                value[more] = mix(value[more] * np.uint64(3)) + hashes[short[more] + k]
            out_doc = np.append(out_doc, doc[short])
            out = np.append(out, mix(value + size.astype(np.uint64)))
            order = np.argsort(out_doc, kind="stable")
            out_doc, out = out_doc[order], out[order]
    return out_doc, mix(out)


def unique_per_text(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, sorted; `doc` must be ascending."""
    if not len(doc):
        return doc, values
    edges = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
    values = values.copy()
    for a, b in zip(edges[:-1], edges[1:]):
        values[a:b].sort()
    keep = np.append(True, (doc[1:] != doc[:-1]) | (values[1:] != values[:-1]))
    return doc[keep], values[keep]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a sort, which is quicker here than hashing."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[:len(values)]]
