"""Union-free regular expressions over the tags of pages, found by aligning the pages of a host.

A page's shape is its sequence of tags and text slots; a slot's token starts with `#`, and what
follows tells kinds of slots apart, so that no alignment mixes them. Within a shape, neighbouring equal groups
fold into one repeated group. A wrapper starts as the first shape of a host and is aligned with one
shape after another: what both have stays, what only one has becomes optional. So a wrapper has
tags, text slots, optional groups and repeated groups, but no alternatives.
"""

import re
from bisect import bisect_left
from collections import Counter

SLOT = "#"

#: Nodes: a tag or slot is a string, a group is ("+" or "?", nodes).
Node = str | tuple
# Letters for distinct nodes: all code points beyond the first plane.
_FIRST_LETTER, _LETTERS = 0x10000, 0x100000
# An alignment fills a table of at most so many cells at once.
_CELLS = 1_000_000


def fold(tokens: list[str]) -> tuple[Node, ...]:
    """Fold neighbouring equal groups of a shape, innermost first."""
    nodes: list[Node] = []
    letters: dict[Node, str] = {}

    def letter(node: Node) -> str:
        if node not in letters:
            letters[node] = chr(_FIRST_LETTER + len(nodes))
            nodes.append(node)
        return letters[node]

    if len(set(tokens)) > _LETTERS // 2:
        return tuple(tokens)  # no regular expression tells so many apart; nothing is folded
    line = "".join(map(letter, tokens))
    for longest in (1, 4, 12, 40, 200):
        square = re.compile(r"(.{1,%d}?)\1+" % longest, re.S)

        def group(m: re.Match) -> str:
            if len(nodes) >= _LETTERS:
                return m[0]
            body = tuple(nodes[ord(c) - _FIRST_LETTER] for c in m[1])
            return letter(body[0] if len(body) == 1 and _is(body[0], "+") else ("+", body))

        before = None
        while before != line:
            before, line = line, square.sub(group, line)
    return tuple(nodes[ord(c) - _FIRST_LETTER] for c in line)


def _is(node: Node, kind: str) -> bool:
    return isinstance(node, tuple) and node[0] == kind


def _same(a: Node, b: Node) -> bool:
    """Whether two nodes can be merged into one."""
    if isinstance(a, str) or isinstance(b, str):
        return a == b
    return _first(a) == _first(b)


def _first(node: Node) -> str:
    return node if isinstance(node, str) else _first(node[1][0])


def _merge(a: Node, b: Node) -> Node:
    if a == b:
        return a
    kind = "?" if "?" in (a[0], b[0]) else "+"
    if kind == "?" and a[0] != b[0]:
        # An optional group met a repeated one: the repeated one becomes optional.
        inner = a[1] if a[0] == "?" else (a,)
        other = b[1] if b[0] == "?" else (b,)
        return ("?", align(inner, other))
    return (kind, align(a[1], b[1]))


def align(a: tuple[Node, ...], b: tuple[Node, ...]) -> tuple[Node, ...]:
    """The expression that fits both, by a longest common subsequence of their nodes."""
    if a == b:
        return a
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    if start or end:
        return (*a[:start], *align(a[start:len(a) - end], b[start:len(b) - end]),
                *a[len(a) - end:])
    n, m = len(a), len(b)
    if n * m > _CELLS:
        return _anchored(a, b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = (best[i + 1][j + 1] + 1 if _same(a[i], b[j])
                          else max(best[i + 1][j], best[i][j + 1]))
    out: list[Node] = []
    only_a: list[Node] = []
    only_b: list[Node] = []

    def close() -> None:
        for run in (only_a, only_b):
            if len(run) == 1 and _is(run[0], "?"):
                out.append(run[0])
            elif run:
                out.append(("?", tuple(run)))
            run.clear()

    i = j = 0
    while i < n and j < m:
        if _same(a[i], b[j]) and best[i][j] == best[i + 1][j + 1] + 1:
            close()
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            only_a.append(a[i])
            i += 1
        else:
            only_b.append(b[j])
            j += 1
    only_a += a[i:]
    only_b += b[j:]
    close()
    return tuple(out)


def _anchored(a: tuple[Node, ...], b: tuple[Node, ...]) -> tuple[Node, ...]:
    """Align long expressions between anchors: nodes that either has once, in the longest chain that
    both have in order. Without anchors both are cut in halves. So memory stays bounded; the
    expression fits both in any case."""
    if len(a) < 2 or len(b) < 2:
        # One node against many: it meets the first like it, all others are optional.
        short, long = (a, b) if len(a) < 2 else (b, a)
        at = next((k for k, x in enumerate(long) if _same(x, short[0])), len(long))
        met = [_merge(short[0], long[at])] if at < len(long) else [_optional(short)]
        return (*([_optional(long[:at])] if at else []), *met,
                *([_optional(long[at + 1:])] if long[at + 1:] else []))
    count_a, count_b = Counter(a), Counter(b)
    place = {x: j for j, x in enumerate(b) if count_b[x] == 1}
    pairs = [(i, place[x]) for i, x in enumerate(a) if count_a[x] == 1 and x in place]
    # The longest rising chain, by the smallest last place of every length.
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back[k] = ends[at - 1] if at else -1
        tails[at:at + 1], ends[at:at + 1] = [j], [k]
    chain = []
    k = ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    if not chain:
        i, j = len(a) // 2, len(b) // 2
        return (*align(a[:i], b[:j]), *align(a[i:], b[j:]))
    out: list[Node] = []
    i = j = 0
    for x, y in reversed(chain):
        out += align(a[i:x], b[j:y])
        out.append(a[x])
        i, j = x + 1, y + 1
    return (*out, *align(a[i:], b[j:]))


def _optional(nodes: tuple[Node, ...]) -> Node:
    return nodes[0] if len(nodes) == 1 and _is(nodes[0], "?") else ("?", tuple(nodes))


def generalise(wrapper: tuple[Node, ...] | None, shape: tuple[Node, ...]) -> tuple[Node, ...]:
    return shape if wrapper is None else align(wrapper, shape)


def leaves(nodes: tuple[Node, ...]) -> list[str]:
    """The tags and slots of an expression in order, those of a group once."""
    return [x for n in nodes for x in ([n] if isinstance(n, str) else leaves(n[1]))]


class Matcher:
    """Finds the tag or slot of an expression that each token of a shape stands for.

    Sets of the places an expression can be at (numbers into `leaves`) are bits of one integer, so
    the work is linear in the tokens, whatever groups are nested.
    """

    def __init__(self, nodes: tuple[Node, ...]):
        self.leaves = leaves(nodes)
        self.follow = [0] * len(self.leaves)
        self.at: dict[str, int] = {}
        for i, token in enumerate(self.leaves):
            self.at[token] = self.at.get(token, 0) | 1 << i
        self.count = 0
        self.empty, self.first, self.last = self._build(nodes)

    def _build(self, nodes: tuple[Node, ...]) -> tuple[bool, int, int]:
        empty, first, last = True, 0, 0
        for node in nodes:
            if isinstance(node, str):
                none, heads, tails = False, 1 << self.count, 1 << self.count
                self.count += 1
            else:
                none, heads, tails = self._build(node[1])
                if node[0] == "+":
                    self._link(tails, heads)
                else:
                    none = True
            self._link(last, heads)
            first |= heads if empty else 0
            last = last | tails if none else tails
            empty = empty and none
        return empty, first, last

    def _link(self, tails: int, heads: int) -> None:
        while tails:
            low = tails & -tails
            self.follow[low.bit_length() - 1] |= heads
            tails ^= low

    def match(self, tokens: list[str]) -> list[int] | None:
        """The leaf of each token, or None if the expression does not fit."""
        states, reach = [], self.first
        for token in tokens:
            here = reach & self.at.get(token, 0)
            if not here:
                return None
            states.append(here)
            reach = 0
            while here:
                low = here & -here
                reach |= self.follow[low.bit_length() - 1]
                here ^= low
        if not states:
            return [] if self.empty else None
        here = states[-1] & self.last
        if not here:
            return None
        out = [(here & -here).bit_length() - 1]
        for before in reversed(states[:-1]):
            bit = 1 << out[-1]
            while not self.follow[(before & -before).bit_length() - 1] & bit:
                before &= before - 1
            out.append((before & -before).bit_length() - 1)
        return out[::-1]

    def fits(self, other: "Matcher", most: int = 20_000) -> bool:
        """Whether this expression accepts all shapes that the other does; after `most` steps that
        counts as unknown, which is False."""
        if other.empty and not self.empty:
            return False
        seen: set[tuple[int, int]] = set()
        todo = [(other.first, self.first)]
        while todo:
            heads, reach = todo.pop()
            while heads:
                i = (heads & -heads).bit_length() - 1
                heads &= heads - 1
                here = reach & self.at.get(other.leaves[i], 0)
                if not here or other.last >> i & 1 and not here & self.last:
                    return False
                if (i, here) in seen:
                    continue
                if len(seen) >= most:
                    return False
                seen.add((i, here))
                after = 0
                while here:
                    after |= self.follow[(here & -here).bit_length() - 1]
                    here &= here - 1
                todo.append((other.follow[i], after))
        return True


def pattern(wrapper: tuple[Node, ...]) -> str:
    """The wrapper as a regular expression over tokens that each end in a space."""
    out = []
    for node in wrapper:
        if isinstance(node, str):
            out.append(re.escape(node) + " ")
        else:
            out.append(f"(?:{pattern(node[1])}){node[0]}")
    return "".join(out)


def encode(nodes: tuple[Node, ...]) -> str:
    """A shape or wrapper as text, for rows of a table."""
    return " ".join(n if isinstance(n, str) else f"( {encode(n[1])} ){n[0]}" for n in nodes)


def decode(text: str) -> tuple[Node, ...]:
    stack: list[list[Node]] = [[]]
    for word in text.split():
        if word == "(":
            stack.append([])
        elif word in (")+", ")?"):
            body = tuple(stack.pop())
            stack[-1].append((word[1], body))
        else:
            stack[-1].append(word)
    return tuple(stack[0])


def slots(wrapper: tuple[Node, ...]) -> int:
    return sum(n.startswith(SLOT) for n in leaves(wrapper))
