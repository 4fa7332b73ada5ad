"""Main text of web pages through wrappers inferred per host.

Each page is read into tags and blocks of text. The distinct shapes of a host's pages are aligned
into a wrapper (see `wrappers`), and every page is matched against the wrapper of its host. A text
slot carries what the containers around it say: part of an article, part of nothing in particular,
or dropped (menus, headers, footers, sidebars, notices, adverts, forms, comments, hidden parts).
Text that a slot holds on all pages of a host that have it is boilerplate too, article or not; in a
repeated slot it counts only if it is there equally often each time. Headings are no boilerplate, and
neither is text of one slot that makes up most of its page, or all of a page.

A page that marks no article takes the container that holds the most text on pages like it: of those
its host's pages chose, the fullest that is on the page and holds most of its text, or else its own.

Distinct shapes of a host are aligned in groups and then group with group. What reaches a page is
its host's wrapper, if that has boilerplate to tell, and at most `CONTAINERS` containers.
"""

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import wrappers
from tidemark.llm.common import keep, slices

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open element of the same kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"},
            "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: Never content, whatever is around them.
DROPPED = frozenset(
    "head title nav aside footer form button select textarea fieldset noscript template iframe svg "
    "canvas object audio video menu dialog".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg"

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)"
    r"""(?P<more>(?:[^>"']|"[^"]*"|'[^']*')*)>"""
    r"|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_HIDING = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_DIGITS = re.compile(r"\d+")
_BOILERPLATE = re.compile(
    r"(?<!no-)(?<!has-)(?<!with-)\b(?:ads?|adverts?|advertisement|advertising|adslot|adsense|banner|"
    r"promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|nav|navbar|"
    r"navigation|menu|breadcrumbs?|sidebar|side-?bar|widgets?|footer|comments?|commentlist|respond|"
    r"disqus|replies|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|"
    r"search|pagination|pager|toolbar|copyright|complementary|contentinfo)\b", re.I)
#: Inside an article only a class, id or role that is nothing but such a word counts.
_BOILERPLATE_WORD = re.compile(
    r"(?:ads?|adverts?|advertisement|advertising|adslot|adsense|banner|promo|promotion|sponsor|"
    r"sponsored|cookies?|consent|gdpr|notices?|popup|modal|overlay|nav|navbar|navigation|menu|"
    r"breadcrumbs?|sidebar|side-bar|widgets?|footer|comments?|commentlist|comment-?list|respond|"
    r"disqus|replies|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|"
    r"pagination|pager|toolbar|complementary|contentinfo)"
    r"(?:-(?:box|block|bar|list|section|container|wrapper|area))?", re.I)
_HEAD = re.compile(r"\b(?:header|masthead|topbar|site-?head)\b", re.I)


#: Pages that must differ before text that they share counts as boilerplate.
MIN_PAGES = 5
#: Groups that the shapes of a host are aligned in, and the most containers a host offers its pages.
GROUPS, CONTAINERS = 16, 32
#: A container holds this share of the text of the one around it, or that one is the content.
MOST = 0.8


def _attributes(more: str) -> tuple[str, str, str, bool]:
    """A tag's first class, its id, all names that tell what it is for, and whether it is hidden."""
    if not _TELLING.search(more):
        return "", "", "", False
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(more):
        found.setdefault(name.lower(), "".join(values))
    classes = found.get("class", "").split()
    names = " ".join(found[x] for x in found if x in ("class", "id", "role"))
    hidden = ("hidden" in found and found["hidden"].lower() != "false"
              or found.get("aria-hidden", "").strip().lower() == "true"
              or _HIDING.search(found.get("style", "")) is not None)
    return classes[0] if classes else "", "".join(found.get("id", "").split()), names, hidden


def read_page(html: str) -> tuple[list[str], list[tuple[str, str]]]:
    """The shape's tokens and the blocks of text, each with the path of containers around it.

    A path that can hold no content ends in "!", one inside an article has "article" or "main". Tags
    of a shape have their first class with digits made alike and no id, since ids name single pages;
    paths have ids. A slot's token ends in "!" if it is dropped, in "?" if it is outside of
    articles, after "h" if it is a heading.
    """
    shape: list[str] = []
    blocks: list[tuple[str, str]] = []
    stack: list[tuple[str, str, bool]] = [("", "", False)]  # tag, path, dropped
    text: list[str] = []

    def close_block() -> None:
        if text:
            words = " ".join(unescape("".join(text)).split())
            text.clear()
            if words:
                path, dropped = stack[-1][1:]
                path = path + "!" if dropped else path
                blocks.append((path, words))
                kind = "!" if dropped else "" if in_article(path) else "?"
                shape.append(wrappers.SLOT + ("h" if shape and _is_heading(shape[-1]) else "") + kind)

    at = 0
    around = _forms_around(html)
    for m in _TOKEN.finditer(html):
        if m.start() > at and (stack[-1][2] is False or not _inside_inline(stack)):
            text.append(html[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in INLINE and not any(s[0] == tag for s in stack):
                continue
            if tag in INLINE:
                while stack[-1][0] != tag:
                    if stack[-1][0] not in INLINE:
                        break
                    stack.pop()
                else:
                    stack.pop()
                continue
            close_block()
            if tag != "p":  # its end may be left out, so it tells nothing
                shape.append("/" + tag)
            if any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        first, own_id, names, hidden = _attributes(m["more"]) if m["more"] else ("", "", "", False)
        boilerplate = bool(names) and (
            any(_BOILERPLATE_WORD.fullmatch(n) for n in names.split()) if in_article(stack[-1][1])
            else _BOILERPLATE.search(names) is not None)
        if tag in INLINE:
            if boilerplate or hidden:
                stack.append((tag, stack[-1][1], True))
            continue
        close_block()
        sign = f"{tag}.{_DIGITS.sub('0', re.sub('[/!#]', '-', first))}" if first else tag
        shape.append(sign)
        if tag in VOID or tag == "p" or tag in _HEADINGS and not boilerplate and not hidden:
            continue
        if tag in SIBLINGS and stack[-1][0] in SIBLINGS[tag]:
            while len(stack) > 1 and stack[-1][0] in SIBLINGS[tag]:
                stack.pop()
        path = f"{stack[-1][1]}/{sign}" + (f"#{re.sub('[/!]', '-', own_id)}" if own_id else "")
        core = tag in ("article", "main", "body", "html")
        inside = "/article" in path or "/main" in path
        head = (tag == "header" or names and _HEAD.search(names) is not None) and not inside
        dropped = (stack[-1][2] or tag in DROPPED and m.start() not in around or hidden
                   or not core and bool(boilerplate or head))
        stack.append((tag, path, dropped))
    if at < len(html):
        tail = html[at:]
        text.append(re.sub(r"<[a-zA-Z/!][^<>]*\Z", "", tail))
    close_block()
    return shape, blocks


_FORM, _FORM_END = re.compile(r"<form\b", re.I), re.compile(r"</form\b", re.I)
_BODY = re.compile(r"<body\b", re.I)


def _forms_around(html: str) -> set[int]:
    """Where forms start that hold most of a page: some servers wrap every page into one."""
    starts = [m.start() for m in _FORM.finditer(html)]
    if not starts:
        return set()
    ends = [m.start() for m in _FORM_END.finditer(html)] + [len(html)]
    body = _BODY.search(html)
    size = len(html) - (body.start() if body else 0)
    return {a for a in starts if 2 * (ends[bisect_left(ends, a)] - a) > size}


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _is_heading(sign: str) -> bool:
    return sign.split(".")[0] in _HEADINGS


def _inside_inline(stack) -> bool:
    """Whether text is in a dropped inline element, where it is no part of the block around it."""
    return stack[-1][0] in INLINE


def in_article(path: str) -> bool:
    return not path.endswith("!") and any(
        re.split("[.#]", part, maxsplit=1)[0] in ("article", "main") for part in path.split("/"))


def host_of(url: str | None) -> str:
    """The host of an address in lower case, without user and port; empty if there is none."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "big",
                          signed=True)


class _Folder:
    """Folded shapes and the numbers of their leaves for the slots of a page, kept for a while."""

    def __init__(self):
        self.known: dict[str, tuple[str, list[str], list[int]]] = {}
        self.size = 0

    def __call__(self, tokens: list[str]) -> tuple[str, list[str], list[int]]:
        """A shape folded as text, its leaves, and which of them each text block of the page is."""
        raw = " ".join(tokens)
        if raw not in self.known:
            if self.size > 8 << 20:
                self.known.clear()
                self.size = 0
            self.size += len(raw)
            nodes = wrappers.fold(tokens)
            matcher = wrappers.Matcher(nodes)
            where = matcher.match(tokens)
            self.known[raw] = (wrappers.encode(nodes), matcher.leaves,
                               [i for i, t in zip(where, tokens) if t.startswith(wrappers.SLOT)])
        return self.known[raw]


def _open(token: str) -> bool:
    """Whether a slot can turn out to be boilerplate: it is no heading and not dropped anyway."""
    return token in (wrappers.SLOT, wrappers.SLOT + "?")


def container(blocks: list[tuple[str, str]]) -> str:
    """The innermost container that holds most of the text of each container around it."""
    amounts: Counter = Counter()
    inside: dict[str, set[str]] = {}
    for path, text in blocks:
        while True:
            amounts[path] += len(text)
            if not path:
                break
            outer = path.rpartition("/")[0]
            inside.setdefault(outer, set()).add(path)
            path = outer
    at = ""
    while at in inside:
        best = min(inside[at], key=lambda p: (-amounts[p], p))
        if amounts[best] < MOST * amounts[at]:
            break
        at = best
    return at


def _held(blocks: list[tuple[str, str]], path: str) -> list[str]:
    return [text for p, text in blocks if p == path or p.startswith(path + "/")]


def _signs(texts: list[str]) -> set[int]:
    """Hashes of the texts of a slot on a page, each with how often it is there."""
    return {_hash(f"{n} {text}") for text, n in Counter(texts).items()}


_SHAPES = ("host string, shape string, path string, n long, pages array<long>, "
           "signs array<array<long>>")


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host of a slice, its shapes with the signs that each slot has on all their pages and hashes
    of pages; and the containers that pages without an article chose."""
    fold = _Folder()
    for batch in slices(batches, "html"):
        found: dict[tuple[str, str], list] = {}
        chars: Counter = Counter()
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            host = host_of(url)
            tokens, blocks = read_page(html or "")
            shape, leaves, where = fold(tokens)
            texts: dict[int, list[str]] = {}
            for i, (_, text) in zip(where, blocks):
                if _open(leaves[i]):
                    texts.setdefault(i, []).append(text)
            signs = [_signs(texts[i]) for i in sorted(texts)]
            page = _hash(" ".join(str(x) for x in chain.from_iterable(map(sorted, signs))))
            if (host, shape) not in found:
                found[host, shape] = [0, {page}, signs]
            row = found[host, shape]
            row[0] += 1
            if len(row[1]) < MIN_PAGES:
                row[1].add(page)
            row[2] = [a & b for a, b in zip(row[2], signs)]
            blocks = [b for b in blocks if not b[0].endswith("!")]
            if blocks and not any(in_article(path) for path, _ in blocks):
                path = container(blocks)
                chars[host, path] += sum(map(len, _held(blocks, path)))
        rows = [(h, s, None, n, sorted(pages), list(map(sorted, signs)))
                for (h, s), (n, pages, signs) in found.items()]
        rows += [(h, None, p, n, None, None) for (h, p), n in chars.items()]
        columns = zip(*rows) if rows else [[]] * 6
        longs = pa.list_(pa.int64())
        kinds = [pa.string()] * 3 + [pa.int64(), longs, pa.list_(longs)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["host", "shape", "path", "n", "pages", "signs"])


_WRAPPER = "host string, n_pages long, wrapper string"


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align the expressions of one group after another; rows come group by group."""
    group, state = None, None

    def finish():
        return pa.RecordBatch.from_arrays(
            [pa.array([group[0]], pa.string()), pa.array([state[2]], pa.int64()),
             pa.array([wrappers.encode(state[0])])], names=["host", "n_pages", "wrapper"])

    for batch in batches:
        for *key, shape, n in zip(*(batch.column(c).to_pylist()
                                    for c in ("host", "part", "shape", "n"))):
            nodes = wrappers.decode(shape)
            if key != group:
                if state is not None:
                    yield finish()
                group, state = key, (nodes, wrappers.Matcher(nodes), n)
                continue
            wrapper, matcher, pages = state
            # A shape that fits already leaves the wrapper as it is, and needs no alignment.
            if not matcher.fits(wrappers.Matcher(nodes)):
                wider = wrappers.generalise(wrapper, nodes)
                if wider != wrapper:
                    wrapper, matcher = wider, wrappers.Matcher(wider)
            state = (wrapper, matcher, pages + n)
    if state is not None:
        yield finish()


def _wrappers(found: DataFrame) -> DataFrame:
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def aligned(rows: DataFrame) -> DataFrame:
        return (rows.repartition(parts, "host", "part")
                .sortWithinPartitions("host", "part", F.desc("n"), "shape")
                .select("host", "part", "shape", "n").mapInArrow(_infer, _WRAPPER))

    groups = aligned(found.filter("shape is not null").groupBy("host", "shape")
                     .agg(F.sum("n").alias("n"))
                     .withColumn("part", F.pmod(F.xxhash64("shape"), F.lit(GROUPS))))
    return aligned(groups.select("host", F.lit(0).cast("long").alias("part"),
                                 F.col("wrapper").alias("shape"), F.col("n_pages").alias("n")))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """One wrapper per host: host, n_pages and wrapper (the union-free expression over tags, slots
    starting with `#`)."""
    return _wrappers(pages.select("url", "html").mapInArrow(_shapes, _SHAPES))


class _Places:
    """Where shapes lie in wrappers, kept for a while. Made inside a task: a cache of the module would
    tie the tasks to an installed package."""

    def __init__(self):
        self.matchers: dict[str, wrappers.Matcher] = {}
        self.known: dict[tuple[str, str], list[int] | None] = {}

    def __call__(self, wrapper: str, shape: str) -> list[int] | None:
        """The slot of a wrapper, by its number among the leaves, of each leaf of a folded shape."""
        if (wrapper, shape) not in self.known:
            if len(self.known) >= 4096:
                self.known.clear()
            if wrapper not in self.matchers:
                if len(self.matchers) >= 256:
                    self.matchers.clear()
                self.matchers[wrapper] = wrappers.Matcher(wrappers.decode(wrapper))
            self.known[wrapper, shape] = self.matchers[wrapper].match(
                wrappers.leaves(wrappers.decode(shape)))
        return self.known[wrapper, shape]


_SLOTS = "host string, slot int, pages array<long>, signs array<long>"


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of wrappers with the signs that they have on all pages."""
    places = _Places()
    for batch in batches:
        found: dict[tuple[str, int], tuple[set, set]] = {}
        for host, wrapper, shape, pages, signs in zip(*(
                batch.column(c).to_pylist() for c in ("host", "wrapper", "shape", "pages", "signs"))):
            where = places(wrapper, shape)
            if where is None:
                continue
            held = [i for i, t in zip(where, wrappers.leaves(wrappers.decode(shape))) if _open(t)]
            here: dict[int, set] = {}
            for slot, x in zip(held, signs):
                here.setdefault(slot, set()).update(x)
            for slot, x in here.items():
                seen, common = found.get((host, slot), (set(), x))
                found[host, slot] = (seen if len(seen) >= MIN_PAGES else seen | set(pages), common & x)
        rows = [(h, s, sorted(p)[:MIN_PAGES], sorted(x)) for (h, s), (p, x) in found.items()]
        kinds = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)],
            names=["host", "slot", "pages", "signs"])


def _common(rows: DataFrame, *key: str) -> DataFrame:
    """The signs that all rows of a key share, and up to MIN_PAGES of their pages."""
    return (rows.groupBy(*key).agg(F.collect_list("signs").alias("all"),
                                   F.collect_set("pages").alias("pages"))
            .select(*key, F.slice(F.array_distinct(F.flatten("pages")), 1, MIN_PAGES).alias("pages"),
                    F.expr("aggregate(all, all[0], (a, b) -> array_intersect(a, b))")
                    .alias("signs")))


def classify(pages: DataFrame) -> DataFrame:
    """What the pages of a host need to know: host, wrapper and boilerplate (numbers of its slots with
    the signs that they have on all of MIN_PAGES or more differing pages; both null without any), and
    containers (those that pages without an article chose, those with the most text first)."""
    found = keep(pages.select("url", "html").mapInArrow(_shapes, _SHAPES))
    inferred = keep(_wrappers(found).select("host", "wrapper"))
    slots = (found.filter("shape is not null").join(inferred, "host")
             .select("host", "wrapper", "shape", "pages", "signs").mapInArrow(_slots, _SLOTS)
             .withColumn("part", F.pmod(F.xxhash64("pages"), F.lit(GROUPS))))
    boilerplate = (_common(_common(slots, "host", "slot", "part"), "host", "slot")
                   .filter(f"size(signs) > 0 and size(pages) >= {MIN_PAGES}")
                   .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "signs")))
                                        .alias("boilerplate")))
    # The fullest of each of CONTAINERS groups, so no host collects more than that.
    chosen = (found.filter("path is not null").groupBy("host", "path").agg(F.sum("n").alias("n"))
              .groupBy("host", F.pmod(F.xxhash64("path"), F.lit(CONTAINERS)).alias("part"))
              .agg(F.max(F.struct("n", "path")).alias("best"))
              .groupBy("host").agg(F.sort_array(F.collect_list("best"), False)
                                   .getField("path").alias("containers")))
    return (inferred.join(boilerplate, "host", "left").join(chosen, "host", "left")
            .select("host", F.when(F.col("boilerplate").isNotNull(), F.col("wrapper"))
                    .alias("wrapper"), "boilerplate", "containers"))


def main_text(html: str, wrapper: str | None = None, boilerplate: dict | None = None,
              containers: tuple[str, ...] = (), fold: _Folder | None = None,
              find: _Places | None = None) -> str:
    """The blocks of the content slots of a page, joined by newlines."""
    tokens, blocks = read_page(html)
    same: list[int | None] = [None] * len(blocks)  # the slot of boilerplate
    if wrapper is not None:
        shape, leaves, where = (fold or _Folder())(tokens)
        places = (find or _Places())(wrapper, shape)
        if places is not None:
            texts: dict[int, list[str]] = {}
            for i, (_, text) in zip(where, blocks):
                if _open(leaves[i]) and places[i] in boilerplate:
                    texts.setdefault(i, []).append(text)
            known = {(i, text) for i, held in texts.items() for text, n in Counter(held).items()
                     if _hash(f"{n} {text}") in boilerplate[places[i]]}
            same = [i if (i, text) in known else None for i, (_, text) in zip(where, blocks)]
    content = [(b, s) for b, s in zip(blocks, same) if in_article(b[0])]
    marked = bool(content)
    if not marked:
        content = [(b, s) for b, s in zip(blocks, same) if not b[0].endswith("!")]
    whole = sum(len(text) for (_, text), _ in content)
    amounts: Counter = Counter()
    for (_, text), s in content:
        amounts[s] += len(text)
    # Text that makes up most of a page is its content, however many pages repeat it.
    kept = ([b for b, s in content if s is None or 2 * amounts[s] > whole]
            or [b for b, _ in content])
    if marked or not kept:
        return "\n".join(text for _, text in kept)
    whole = sum(len(text) for _, text in kept)
    for path in containers:
        texts = _held(kept, path)
        if 2 * sum(map(len, texts)) > whole:
            return "\n".join(texts)
    return "\n".join(_held(kept, container(kept)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold, find = _Folder(), _Places()
    for batch in slices(batches, "html"):
        out = [main_text(html or "", wrapper, {x["slot"]: set(x["signs"]) for x in slots or ()},
                         tuple(paths or ()), fold, find)
               for html, wrapper, slots, paths in zip(*(
                   batch.column(c).to_pylist()
                   for c in ("html", "wrapper", "boilerplate", "containers")))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())],
            names=["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the article) and n_chars of every page.

    Reads `page_id`, `url` and `html`; other columns are ignored. Character references are decoded,
    white space within a block becomes one space, blocks are joined by one newline. Text that is in its
    slot, equally often, on all of five or more differing pages of a host is left out, unless it is a
    heading, all of its page, or text of one slot that is most of its page. A form that
    holds most of a page is read like any container. Pages have any length. A null or empty html, or
    one without content, gives an empty text.
    Pages without a host share one wrapper.
    Unclosed tags end where their container ends. A row per input row, repeated rows and null ids
    included; an empty table gives an empty table.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    known = keep(classify(rows))
    host = F.lower(F.regexp_extract(
        F.coalesce("url", F.lit("")),
        r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = rows.withColumn("host", host).join(known, "host", "left")
    return (joined.select("page_id", "url", "html", "wrapper", "boilerplate", "containers")
            .mapInArrow(_extract, "page_id long, url string, text string")
            .withColumn("n_chars", F.length("text").cast("long")))
