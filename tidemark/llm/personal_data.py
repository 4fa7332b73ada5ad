"""Personal data: patterns, and terms that give a protected entity away.

Mail addresses, network addresses, card and phone numbers are found by pattern. Each distinct one is a
protected entity c. What else gives it away is estimated from the corpus, in the manner of
information-theoretic sanitisation: IC(c) = log2(words / mentions of c) is the information that the
entity carries, and a term t near it discloses PMI(c; t) = IC(c) + log2 p(c | t) of it, where p(c | t) is
the share of all occurrences of t in the corpus that stand near c. A term whose share PMI / IC reaches
the threshold is generalised to its first three code points, if all terms that start so disclose less
than that, and else removed. A term counts only where it stands near c in three or more different
contexts, so that copies of one text, and rare words beside a single mention, prove nothing.

Patterns are matched with whole runs, so texts of any content take linear time.
"""

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import keep, scratch, slices

#: Kinds of spans, in the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone", "term")
#: Terms on each side of a mention that count as near.
NEAR = 8
MIN_CONTEXTS = 3
DISCLOSURE = 0.9
PREFIX = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)
#: Runs without ASCII control and punctuation, Latin-1 signs, general and East Asian punctuation.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\u00BF\u2000-\u206F\u3000-\u303F]+"

_TERM = re.compile(TERM)
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From sign to sign: what can belong to an address right before it, and a domain behind it."""
    free, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, sign + 1) if start < sign else None
        if domain:
            free = domain.end()
            yield start, free
        sign = text.find("@", sign + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of what the patterns find, by start and kind."""
    out = [(a, b, "email", text[a:b].translate(_TO_LOWER)) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = m[0].split(".")
        if all(map(_small, parts)):
            out.append((*m.span(), "ip", ".".join(p.lstrip("0") or "0" for p in parts)))
    for m in _CARD.finditer(text):
        # Nineteen digits with a sign between all of them have 37 code points.
        if 14 <= len(m[0]) <= 37:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((*m.span(), "card", digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 10 <= len(digits) <= 15:
                out.append((*m.span(), "phone", digits))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def contexts(text: str, spans) -> list[tuple[str, str, list[tuple[str, int, int]]]]:
    """Per mention (entity, context, near terms with start and end). Entity and context are digests. A
    place is listed once per entity, and no term overlaps a span."""
    terms = []
    spans = list(spans)
    taken = sorted((a, b) for a, b, _, _ in spans)
    k, reach = 0, 0
    for m in _TERM.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= m.start():
            terms.append((m[0].translate(_TO_LOWER), m.start(), m.end()))
    starts = [t[1] for t in terms]
    out, seen = [], set()
    for a, b, kind, value in spans:
        entity = hashlib.sha256(f"{kind}:{value}".encode()).hexdigest()[:32]
        left, right = bisect_left(starts, a), bisect_left(starts, b)
        near = terms[max(0, left - NEAR):left] + terms[right:right + NEAR]
        context = hashlib.sha256(" ".join(t[0] for t in near).encode()).hexdigest()[:32]
        new = [t for t in near if (entity, t[1]) not in seen]
        seen.update((entity, t[1]) for t in new)
        out.append((entity, context, new))
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()),
                            ("kind", pa.string())]))
_CONTEXT = pa.list_(pa.struct([
    ("entity", pa.string()), ("context", pa.string()),
    ("terms", pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()),
                                  ("end", pa.int64())])))]))
_FOUND = ("base array<struct<start:long,rank:int,end:long,kind:string>>, mentions array<struct<"
          "entity:string,context:string,terms:array<struct<term:string,start:long,end:long>>>>")


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        base, mentions = [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text)
            base.append([{"start": a, "rank": KINDS.index(k), "end": b, "kind": k}
                         for a, b, k, _ in spans])
            mentions.append([
                {"entity": e, "context": c,
                 "terms": [{"term": t, "start": a, "end": b} for t, a, b in terms]}
                for e, c, terms in contexts(text, spans)] if spans else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, _SPAN), pa.array(mentions, _CONTEXT)],
            names=["row", "base", "mentions"])


def _term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): the occurrences of every term in all texts."""
    words = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def disclosing_terms(near: DataFrame, mentions: DataFrame, counts: DataFrame,
                     min_contexts: int = MIN_CONTEXTS,
                     disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term, share, general): the terms near an entity that disclose at least `disclosure` of
    it; `general` says that the first code points of the term disclose less.

    `near` has a row per term near a mention (entity, context, term), `mentions` one per mention
    (entity), `counts` the corpus count `n` per term.
    """
    seen = near.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy(
        "entity", "term").agg(F.sum("n").alias("n_near"), F.count("*").alias("n_contexts"))
    words = counts.agg(F.sum("n")).first()[0] or 1
    entities = mentions.groupBy("entity").agg(F.count("*").alias("n_entity"))
    start = F.substring("term", 1, PREFIX)
    of_start = counts.groupBy(start.alias("_start")).agg(F.sum("n").alias("n_start"))
    near_start = seen.groupBy("entity", start.alias("_start")).agg(
        F.sum("n_near").alias("n_near_start"))

    def share(near_n: str, n: str) -> Column:
        information = F.log2(F.lit(float(words)) / F.col("n_entity"))
        given = F.log2(F.col(near_n) / F.col(n))
        return F.when(information > 0, (information + given) / information).otherwise(F.lit(1.0))

    found = (
        seen.filter(F.col("n_contexts") >= min_contexts)
        .join(counts, "term").join(entities, "entity")
        .withColumn("share", share("n_near", "n")).filter(F.col("share") >= disclosure)
        .withColumn("_start", start)
    )
    return found.join(of_start, "_start").join(near_start, ["entity", "_start"]).select(
        "entity", "term", "share", ((F.length("term") > PREFIX) & (
            share("n_near_start", "n_start") < disclosure)).alias("general"))


def find_personal_data(docs: DataFrame, carry: list[str] | None = None,
                       min_contexts: int = MIN_CONTEXTS,
                       disclosure: float = DISCLOSURE) -> DataFrame:
    """The personal data of every text: the columns `carry` of `docs` (all by default), and `found`,
    an array of start, rank, end (code points, exclusive), kind and general, by start and kind.

    Kinds are email, ip, card, phone and term; a term is found near a mention of the entity that it
    gives away, in every text that mentions it, and `general` says that it is to be generalised and not
    removed. A null text is empty and has none; an empty table gives an empty one. Texts have any
    length. Repeated rows and ids stay as they are, ids may be null. A column `found` of `docs` is
    replaced, other names do not matter.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c != "found"]
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), F.coalesce(
        F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = StructType([packed.schema["row"], *StructType.fromDDL(_FOUND).fields])
    with scratch(docs.sparkSession) as tables:
        # Written with a number per row, which later joins rely on.
        rows = tables.table(packed.mapInArrow(_detect, schema).withColumn(
            "number", F.monotonically_increasing_id()))
        mentions = rows.select("number", F.explode("mentions").alias("m")).select("number", "m.*")
        near = mentions.select("number", "entity", "context", F.explode("terms").alias("t")).select(
            "number", "entity", "context", "t.*")
        counts = tables.table(_term_counts(packed))
        told = tables.table(disclosing_terms(near, mentions, counts, min_contexts, disclosure))
        # Where several entities are given away, removing goes before generalising.
        terms = (
            near.join(told, ["entity", "term"])
            .groupBy("number", "start", "end").agg(F.min("general").alias("general"))
            .groupBy(F.col("number").alias("_number")).agg(F.collect_list(F.struct(
                "start", F.lit(KINDS.index("term")).alias("rank"), "end",
                F.lit("term").alias("kind"), "general")).alias("_terms"))
        )
        base = F.transform("base", lambda s: F.struct(
            s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"),
            s["kind"].alias("kind"), F.lit(False).alias("general")))
        none = F.col("_terms").isNull()
        return keep(rows.join(terms, F.col("number") == F.col("_number"), "left").select(
            "row.*", F.when(none, base).otherwise(F.sort_array(F.concat(base, "_terms"))).alias(
                "found")))


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: str, found) -> str:
    """A text without what was found in it: terms cut to their first code points or gone, everything
    else replaced by its kind in brackets. Of spans that overlap one mark stays."""
    out, at = [], 0
    for span in found:
        a, b = span["start"], span["end"]
        if a >= at:
            out.append(text[at:a])
            if span["kind"] != "term":
                out.append(f"[{span['kind']}]")
            elif span["general"]:
                out.append(text[a:a + PREFIX] + "*")
        at = max(at, b)
    return "".join(out) + text[at:]


def _sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        at = batch.schema.get_field_index("text")
        done = [None if t is None else sanitised(t, f) for t, f in zip(
            batch.column(at).to_pylist(), batch.column("found").to_pylist())]
        yield batch.set_column(at, "text", pa.array(done, pa.string()))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """`docs` with sanitised texts and the column `found` of what was in them, where `found` refers to
    the texts before. See `find_personal_data`; a null text stays null."""
    found = find_personal_data(docs, **options)
    return found.mapInArrow(_sanitise, found.schema)
