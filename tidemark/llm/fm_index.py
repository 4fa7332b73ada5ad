"""A bidirectional FM-index over a set of words, and the search for words one error away.

The index holds the words, sorted and each ended by a delimiter, as two Burrows-Wheeler transforms:
of the words and of the words read backwards. A pattern is a pair of intervals of equal size, the
ranks of the suffixes that start with it in either direction. Extending it on the left by a symbol
counts symbols in the first transform, on the right in the second; the other interval moves by the
number of smaller symbols. Both transforms are wavelet matrices of cumulative counts, so that all
intervals of a batch of queries move at once by array look-ups.

The search scheme has two searches. Each matches one half of the query exactly, the delimiter
included, then turns round and extends across the other half, allowing one error. The second search
is the first one over words and queries read backwards.
"""

import numpy as np

_END = "\0"


class _Ranks:
    """Counts of symbols before any position of a sequence, as a wavelet matrix."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.zeros, self.n_zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            counts = np.zeros(len(sequence) + 1, np.int64)
            np.cumsum(1 - bit, out=counts[1:])
            self.zeros.append(counts)
            self.n_zeros.append(int(counts[-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        self.bits = bits
        symbols = np.arange(1 << bits)
        self.start = np.zeros(1 << bits, np.int64)
        self.start = self.step(symbols, np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64))[0]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Per query the symbol's count before `low` and inside [low, high), and that of smaller ones."""
        less = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            counts, n = self.zeros[level], self.n_zeros[level]
            left, right = counts[low], counts[high]
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            less += np.where(one, right - left, 0)
            low = np.where(one, n + low - left, left)
            high = np.where(one, n + high - right, right)
        return low - self.start[symbol], high - low, less

    def branch(self, low: np.ndarray, high: np.ndarray):
        """All symbols inside [low, high): (query, symbol, count before, count inside, smaller)."""
        query = np.arange(len(low))
        symbol, less = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for level in range(self.bits):
            counts, n = self.zeros[level], self.n_zeros[level]
            left, right = counts[low], counts[high]
            zero, one = right > left, high - right > low - left
            query = np.concatenate([query[zero], query[one]])
            less = np.concatenate([less[zero], (less + right - left)[one]])
            symbol = np.concatenate([2 * symbol[zero], 2 * symbol[one] + 1])
            low, high = (np.concatenate([left[zero], (n + low - left)[one]]),
                         np.concatenate([right[zero], (n + high - right)[one]]))
        return query, symbol, low - self.start[symbol], high - low, less


def _transform(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol before every suffix of every word, in the order of the suffixes.

    Every word is read as a circle with its delimiter; delimiters are ordered by word, so no two
    suffixes are equal. Ranks of windows double in length until they differ everywhere.
    """
    n = len(symbols)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    width = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:n - width] = rank[width:] if width < n else 0
        key = rank * (int(rank.max()) + 1) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        rank = new
        if rank.max() == n - 1:
            break
        width *= 2
    before = np.arange(n) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    before[starts] = ends
    return symbols[before[order]]


class WordIndex:
    """The index over distinct words in code-point order."""

    def __init__(self, words: list[str]):
        joined = np.frombuffer((_END.join(words) + _END).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(joined)
        symbols = np.searchsorted(self.alphabet, joined)
        ends = np.flatnonzero(symbols == 0)
        bits = max(1, int(len(self.alphabet) - 1).bit_length())
        self.n = len(symbols)
        counts = np.bincount(symbols, minlength=1 << bits)
        self.before = np.cumsum(counts) - counts
        self.left = _Ranks(_transform(symbols, ends), bits)
        # The same words read backwards, each in its old place.
        starts = np.concatenate([[0], ends[:-1] + 1])
        length = ends - starts
        place = np.arange(self.n)
        word = np.repeat(np.arange(len(ends)), length + 1)
        mirror = np.where(place == ends[word], place, starts[word] + ends[word] - 1 - place)
        self.right = _Ranks(_transform(symbols[mirror], ends), bits)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words, -1 for one the index does not have, and the words' offsets."""
        joined = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, joined), len(self.alphabet) - 1)
        codes = np.where(self.alphabet[at] == joined, at, -1)
        return codes, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)

    def extend_left(self, symbol, low, back, size):
        count, inside, less = self.left.step(symbol, low, low + size)
        return self.before[symbol] + count, back + less, inside

    def extend_right(self, symbol, low, back, size):
        count, inside, less = self.right.step(symbol, back, back + size)
        return low + less, self.before[symbol] + count, inside

    def branch_right(self, low, back, size):
        query, symbol, count, inside, less = self.right.branch(back, back + size)
        return query, symbol, low[query] + less, self.before[symbol] + count, inside

    def near(self, words: list[str], second: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all words that start with the first half of a query and are one
        error away from it; in the `second` search without those that agree with the query up to
        the middle of the word as it is read there, which the first search finds."""
        codes, offset = self.codes(words)
        length = np.diff(offset)
        half = length - length // 2 if second else length // 2

        # One half exactly, from the middle to the delimiter.
        n = len(words)
        low, back, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.n)
        for step in range(int(half.max(initial=0))):
            on = np.flatnonzero((step < half) & (size > 0))
            symbol = codes[offset[on] + half[on] - 1 - step]
            size[on[symbol < 0]] = 0
            on, symbol = on[symbol >= 0], symbol[symbol >= 0]
            low[on], back[on], size[on] = self.extend_left(symbol, low[on], back[on], size[on])
        zero = np.zeros(n, np.int64)
        low, back, size = self.extend_left(zero, low, back, size)

        # The other half, first without an error, then with one behind.
        query = np.flatnonzero(size > 0)
        at, low, back, size = half[query], low[query], back[query], size[query]
        run = self._run(codes, offset, length, half) if second else None
        state = [np.empty(0, np.int64)] * 5
        found_query, found_word = [], []
        while len(query) or len(state[0]):
            # States with their error behind them go on exactly.
            if len(state[0]):
                q, i, lo, ba, si = state
                more = i < length[q]
                symbol = np.zeros(len(q), np.int64)
                symbol[more] = codes[offset[q[more]] + i[more]]
                known = symbol >= 0
                q, i, more, symbol = q[known], i[known], more[known], symbol[known]
                lo, ba, si = self.extend_right(symbol, lo[known], ba[known], si[known])
                done = ~more & (si > 0)
                found_query.append(q[done])
                found_word.append(lo[done])
                on = more & (si > 0)
                state = [q[on], i[on] + 1, lo[on], ba[on], si[on]]
            if not len(query):
                continue
            # All ways of a state without an error.
            who, symbol, lo, ba, si = self.branch_right(low, back, size)
            q, i = query[who], at[who]
            more = i < length[q]
            wanted = np.full(len(q), -1, np.int64)
            wanted[more] = codes[offset[q[more]] + i[more]]
            match = more & (symbol == wanted)
            other = (symbol != wanted) & (symbol != 0)
            replaced = other & more
            extra = other
            inside = at < length[query]
            nxt = np.full(len(query), -2, np.int64)
            ahead = at + 1 < length[query]
            nxt[ahead] = codes[offset[query[ahead]] + at[ahead] + 1]
            here = np.full(len(query), -3, np.int64)
            here[inside] = codes[offset[query[inside]] + at[inside]]
            # Of equal neighbours the last is left out or followed by an extra one.
            absent = inside & ((here != nxt) | (here < 0))
            if second:
                same, border = run
                absent &= ~((at - half[query] < same[query]) & border[query])
                first = codes[offset[q] + np.minimum(half[q], length[q] - 1)]
                read = i - half[q]
                extra = extra & ~((read == 0) | ((read <= same[q]) & (symbol == first)))
            new = [
                (q[replaced], i[replaced] + 1, lo[replaced], ba[replaced], si[replaced]),
                (q[extra], i[extra], lo[extra], ba[extra], si[extra]),
                (query[absent], at[absent] + 1, low[absent], back[absent], size[absent]),
            ]
            state = [np.concatenate([s, *[x[k] for x in new]]) for k, s in enumerate(state)]
            query, at = q[match], i[match] + 1
            low, back, size = lo[match], ba[match], si[match]
        if not found_query:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_query), np.concatenate(found_word)

    @staticmethod
    def _run(codes, offset, length, half):
        """How many symbols behind the middle are equal, and whether they equal the one before it."""
        n = len(length)
        same, on = np.zeros(n, np.int64), np.flatnonzero(half < length)
        first = np.full(n, -1, np.int64)
        first[on] = codes[offset[on] + half[on]]
        same[on] = 1
        while len(on):
            on = on[half[on] + same[on] < length[on]]
            on = on[codes[offset[on] + half[on] + same[on]] == first[on]]
            same[on] += 1
        border = np.zeros(n, bool)
        on = np.flatnonzero((half > 0) & (half < length))
        border[on] = codes[offset[on] + half[on] - 1] == first[on]
        return same, border
