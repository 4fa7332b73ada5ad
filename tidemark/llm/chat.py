"""Chat formatting of typed content parts.

A message is a list of parts of the kinds text, image, audio and document. A visitor walks the parts
in order: text is escaped and written out, every other part leaves a placeholder, and the visitor
records what it refers to and how many tokens it will expand to. The template marks turns with
control strings; wherever a text or a role holds a control string, of this template or of another
common one, a backslash after its first character takes its force. Reading back removes it.

Formatting is per message and needs no shuffle. What is about whole conversations, such as digests of
the turns read back, streams over messages sorted by conversation, one message at a time.
"""

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SLICE_BYTES

START, ROLE_END, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"

#: Control strings of common chat templates, which texts must not forge.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>",
           "<end_of_turn>")

_FIRST = tuple(sorted({c[0] for c in CONTROL}))
_GUARD = re.compile("|".join(rf"({re.escape(c[0])})(\\*)({re.escape(c[1:])})" for c in CONTROL))
_MESSAGE = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.S)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
MESSAGE = "struct<role:string,parts:array<" + PART + ">>"
_FORMATTED = ("segment string, loss_start long, loss_end long, n_tokens long, "
              "attachments array<struct<at:long,kind:string,uri:string,tokens:long>>")


def escape(text: str) -> str:
    """Put one more backslash into every control string, escaped or not, so that it is undone."""
    return text if _harmless(text) else _GUARD.sub(lambda m: "\\".join(_pieces(m)), text)


def unescape(text: str) -> str:
    """Take one backslash out of every escaped control string."""
    def plain(m):
        head, slashes, tail = (g for g in m.groups() if g is not None)
        return head + slashes[1:] + tail
    return text if _harmless(text) else _GUARD.sub(plain, text)


def _harmless(text: str) -> bool:
    """Whether a text has no letter that a control string starts with."""
    return not any(c in text for c in _FIRST)


def _pieces(m) -> tuple[str, str]:
    head, slashes, tail = (g for g in m.groups() if g is not None)
    return head, slashes + tail


@dataclass
class Rates:
    """Tokens that an attachment expands to."""

    tile: int = 512
    tokens_per_tile: int = 170
    tokens_per_image: int = 85
    tokens_per_second: float = 25.0
    tokens_per_page: int = 600


@dataclass
class Flattener:
    """Visits the parts of one message and gathers its text, attachments and token count."""

    rates: Rates = field(default_factory=Rates)

    def flatten(self, parts) -> tuple[str, list[dict], int]:
        self.out, self.found, self.tokens, self.texts = [], [], 0, []
        for part in parts or []:
            kind = (part or {}).get("kind") or "text"
            visit = getattr(self, f"visit_{kind}", None)
            if visit is None:
                raise ValueError(f"unknown kind of part: {kind}")
            visit(part or {})
        self._end_text()
        return "".join(self.out), self.found, self.tokens

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.texts.append(text)
        self.tokens += len(text.split())

    def _end_text(self) -> None:
        """Neighbouring texts are escaped as one, since a control string may lie across them."""
        self.out.append(escape("".join(self.texts)))
        self.texts = []

    def visit_image(self, part: dict) -> None:
        r = self.rates
        tiles = -(-(part.get("width") or r.tile) // r.tile) * -(-(part.get("height") or r.tile) // r.tile)
        self._attach("image", part, r.tokens_per_image + tiles * r.tokens_per_tile)

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds") or 0.0
        self._attach("audio", part, max(1, round(seconds * self.rates.tokens_per_second)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 1) * self.rates.tokens_per_page)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self._end_text()
        at = len(self.found)
        self.out.append(f"<|{kind}:{at}|>")
        self.found.append({"at": at, "kind": kind, "uri": part.get("uri"), "tokens": tokens})
        self.tokens += tokens


def format_message(role: str | None, parts, flattener: Flattener):
    """(segment, loss span, attachments, tokens); only what an assistant says is under the loss."""
    body, found, tokens = flattener.flatten(parts)
    head = f"{START}{escape(role or '')}{ROLE_END}"
    segment = head + body + END
    end = len(head) + len(body)
    # Both borders must be safe: a text may end with what begins a control string.
    span = (len(head), end) if role == "assistant" else (0, 0)
    return segment, span, found, tokens


def read_segment(segment: str) -> tuple[str, str]:
    """The role and the text of a formatted message; placeholders stay in the text."""
    head, body = segment[len(START):-len(END)].split(ROLE_END, 1)
    return unescape(head), unescape(body)


def read_conversation(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a whole formatted conversation."""
    return [(unescape(role), unescape(body)) for role, body in _MESSAGE.findall(formatted)]


def text_parts(text: Column) -> Column:
    """A plain text as the only part of a message."""
    none = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.cast("string").alias("text"),
        none.cast("string").alias("uri"), none.cast("int").alias("width"),
        none.cast("int").alias("height"), none.cast("double").alias("seconds"),
        none.cast("int").alias("pages")))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flattener = Flattener()
    kind = pa.list_(pa.struct([("at", pa.int64()), ("kind", pa.string()), ("uri", pa.string()),
                               ("tokens", pa.int64())]))
    for whole in batches:
        step = max(1, int(whole.num_rows * SLICE_BYTES / max(SLICE_BYTES, whole.nbytes)))
        for a in range(0, whole.num_rows, step):
            batch = whole.slice(a, step)
            done = [format_message(role, parts, flattener) for role, parts in zip(
                batch.column("role").to_pylist(), batch.column("_parts").to_pylist())]
            columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_parts"]
            names = [n for n in batch.schema.names if n != "_parts"]
            yield pa.RecordBatch.from_arrays(columns + [
                pa.array([d[0] for d in done], pa.string()),
                pa.array([d[1][0] for d in done], pa.int64()),
                pa.array([d[1][1] for d in done], pa.int64()),
                pa.array([d[3] for d in done], pa.int64()),
                pa.array([d[2] for d in done], kind),
            ], names=names + ["segment", "loss_start", "loss_end", "n_tokens", "attachments"])


def format_messages(messages: DataFrame, parts: Column | None = None) -> DataFrame:
    """Every message formatted: conv_id, turn, role, segment (its share of the formatted
    conversation), the span of the segment under the loss mask (`loss_start`, `loss_end`, in code
    points), n_tokens (words of the text and expanded tokens of the attachments) and attachments
    (their number, kind, reference and tokens, in the order of the placeholders).

    `parts` is an array of `PART`; without it the column `text` is the only part. The segments of a
    conversation, joined by turn, are the formatted conversation. A null text, part or list of
    parts is empty, a part without kind is text, a null role is an empty one; only the role
    `assistant` is under the loss. Null ids and turns stay null and repeated rows are formatted one
    by one; other columns are dropped. Texts have any length. A part of an unknown kind is an error
    that names the kind and ends the job. An empty table gives an empty table.
    """
    parts = text_parts(F.col("text")) if parts is None else parts
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"),
                           F.col("turn").cast("long").alias("turn"),
                           F.col("role").cast("string").alias("role"), parts.alias("_parts"))
    return rows.mapInArrow(_format, "conv_id long, turn long, role string, " + _FORMATTED)


def conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted) with all segments joined, for conversations that fit into one row."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "segment")))
    return formatted.groupBy("conv_id").agg(
        F.array_join(F.transform(ordered, lambda m: m["segment"]), "").alias("formatted"))


_DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, segment: str, start: int, end: int) -> None:
        # Through the template, so that a text that was not escaped well shows.
        for role, text in read_conversation(segment):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        learned = unescape(segment[start:end])
        self.loss.update(learned.encode())
        self.loss_chars += len(learned)
        self.chars += len(segment)

    def row(self, conv_id) -> tuple:
        return (conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.chars)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    current, digest = None, None

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        done = []
        for conv_id, segment, start, end in zip(*(batch.column(c).to_pylist() for c in (
                "conv_id", "segment", "loss_start", "loss_end"))):
            if digest is None or conv_id != current:
                if digest is not None:
                    done.append(digest.row(current))
                current, digest = conv_id, _Digest()
            digest.add(segment, start, end)
        if done:
            yield batch_of(done)
    if digest is not None:
        yield batch_of([digest.row(current)])


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What reading each formatted conversation back gives: n_turns, turns_sha256 (role, newline,
    text, newline per turn), loss_chars and loss_sha256 (the text under the loss mask),
    formatted_chars.

    Messages go by turn, then role, then segment; a null turn comes first. A null conv_id is one
    conversation. Messages stream through one digest per conversation, however long it is.
    """
    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (formatted.select("conv_id", "turn", "role", "segment", "loss_start", "loss_end")
            .repartition(parts, "conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "segment")
            .mapInArrow(_digests, _DIGEST))
