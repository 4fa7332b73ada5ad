"""Plain models of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def gram_set(text, n):
    w = words(text)
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(rows, n, percent):
    """(doc_id, text) rows -> per row (doc_id, set size, smallest id reachable)."""
    sets = [gram_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    names = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)].append(d)
    return [(d, len(sets[i]), min(names[find(i)], default=None) if sets[i] else d)
            for i, (d, _) in enumerate(rows)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
