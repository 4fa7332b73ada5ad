"""Repair of conversation structure: the cheapest edits, found by an auction for shortest paths.

A repaired conversation has the role initials `(s?(ua)+)?`. Its rows and the four states of that
grammar span a lattice with integer costs: a row is kept (0), given the role that fits (1) or deleted
(2, the only way for blank and repeated rows), an empty row may be inserted anywhere (5), and a
truncated row that stays costs 5 more.

The auction algorithm keeps a price per node and a path from the origin. At the end of the path it
raises the node's price to the cheapest way on and contracts the path, or extends it along an arc
that the prices make tight. Ties extend in the order of the edits' initials; as prices only rise, an
arc that was not tight never becomes so, and the converged prices expose the least of all cheapest
paths: following the first tight arc from the origin traces it without dead ends.

No conversation is gathered in one task. Rows are sorted over all tasks and cut into segments of at
most `SEGMENT_ROWS`. A conversation in one segment is solved at once. The segments of a longer one
are solved apart, for every state at both ends; one small row per segment then carries the prices back
and the states forth.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, keep, scratch

SEGMENT_ROWS = 1024
_BLOCK_ROWS = 32

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: White space in the sense of the faults.
BLANKS = r"\x20\x09-\x0D"

# States: nothing yet, after s, after u, after a. What a row makes of a state, by its initial.
_FITS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
# The state after a row with the role that fits, and the states that can be reached at all.
_GROWS = (2, 2, 3, 2)
_REACH = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))
_ROLE = {2: "user", 3: "assistant"}
_FAR = 1 << 40
#: Prices behind the last row: nothing or a complete pair.
_END = (0, _FAR, _FAR, 0)

_ROW = "struct<place:long,initial:string,fault:string,copies:long,turn:long>"
_OP = "struct<place:long,part:int,edit:string,times:long,role:string>"


class _Block:
    """The lattice of some rows; `leave` are the prices of the four states behind them."""

    def __init__(self, rows: list[dict], leave, last: bool):
        self.n = len(rows)
        self.end = 4 * (self.n + 1)
        least = [0] * (self.n + 1)
        self.arcs = [[] for _ in range(self.end)]
        for i in range(self.n - 1, -1, -1):
            row, extra = rows[i], DELETE * (rows[i]["copies"] - 1)
            gone = row["fault"] in ("blank", "duplicate")
            stay = TRUNCATED if row["fault"] == "truncated" else 0
            least[i] = least[i + 1] + extra + (DELETE if gone else min(DELETE, stay + KEEP))
            fits = _FITS.get(row["initial"], {})
            for q in range(4):
                arcs = self.arcs[4 * i + q]
                arcs.append((DELETE + extra, 4 * (i + 1) + q, "D"))
                arcs.append((INSERT, 4 * i + _GROWS[q], "I"))
                if not gone:
                    if q in fits:
                        arcs.append((KEEP + stay + extra, 4 * (i + 1) + fits[q], "K"))
                    arcs.append((REROLE + stay + extra, 4 * (i + 1) + _GROWS[q], "R"))
        for q in range(4):
            if leave[q] < _FAR:
                self.arcs[4 * self.n + q].append((leave[q], self.end, ""))
            if last:
                self.arcs[4 * self.n + q].append((INSERT, 4 * self.n + _GROWS[q], "I"))
        # No arc costs less than the fall of these prices along it.
        best = [min(leave[r] for r in _REACH[q]) for q in range(4)]
        self.price = [min(best[q] + least[i], _FAR) for i in range(self.n + 1) for q in range(4)]
        self.price.append(0)

    def auction(self, state: int) -> int:
        """Converge the prices for the way from `state` before the rows; the cost of that way."""
        price, arcs = self.price, self.arcs
        path = [state]
        while path[-1] != self.end:
            node = path[-1]
            best = min([cost + price[to] for cost, to, _ in arcs[node]], default=_FAR)
            if price[node] < min(best, _FAR):
                price[node] = min(best, _FAR)
                if len(path) > 1:
                    path.pop()
            elif price[node] == _FAR:  # only the origin: no way on
                break
            else:
                path.append(next(to for cost, to, _ in arcs[node] if cost + price[to] == best))
        return price[state]

    def trace(self, state: int) -> tuple[list[tuple[int, str, int]], int]:
        """(row, edit, state behind it) of the least tight way, and the state behind the rows."""
        edits, node = [], state
        while True:
            _, to, letter = next(
                a for a in self.arcs[node] if a[0] + self.price[a[1]] == self.price[node])
            if to == self.end:
                return edits, node % 4
            edits.append((node // 4, letter, to % 4))
            node = to


class _Lattice:
    """The lattice of a segment in blocks, solved from the last to the first."""

    def __init__(self, rows: list[dict], leave, last: bool, states=(0, 1, 2, 3)):
        starts = range(0, len(rows), _BLOCK_ROWS)
        self.blocks, prices = [], leave
        for at in reversed(starts):
            block = _Block(rows[at:at + _BLOCK_ROWS], prices, last and at == starts[-1])
            prices = [_FAR] * 4
            for q in (range(4) if at else states):
                prices[q] = block.auction(q)
            self.blocks.append((at, block))
        self.prices = prices
        self.blocks.reverse()

    def trace(self, state: int) -> tuple[list[tuple[int, str, int]], int]:
        edits = []
        for at, block in self.blocks:
            some, state = block.trace(state)
            edits += [(at + i, letter, q) for i, letter, q in some]
        return edits, state


def cheapest_edits(rows: list[dict]) -> tuple[int, list[tuple[int, str, int]]]:
    """Cost and (row, edit, state) for one whole conversation; `rows` hold initial, fault, copies."""
    if not rows:
        return 0, []
    lattice = _Lattice(rows, _END, True, (0,))
    return lattice.prices[0], lattice.trace(0)[0]


def _mapped(function, schema: str):
    """Rows of every batch through `function(dict) -> dict`."""
    names = [c.strip().split(" ")[0] for c in schema.replace("<", " ").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                done = [function(row) for row in batch.slice(at, 256).to_pylist()]
                kinds = kinds or _arrow(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d[n] for d in done], k) for n, k in zip(names, kinds)], names=names)
    return run


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(),
          "array<long>": pa.list_(pa.int64()), "array<" + _OP + ">": pa.list_(pa.struct([
              ("place", pa.int64()), ("part", pa.int32()), ("edit", pa.string()),
              ("times", pa.int64()), ("role", pa.string())]))}


def _arrow(schema: str) -> list[pa.DataType]:
    return [_KINDS[c.strip().split(" ", 1)[1]] for c in schema.split(", ")]


def _costs(row: dict) -> dict:
    """What a segment costs from every state before it (4) to every state behind it (4)."""
    out = []
    for q in range(4):
        leave = _END if row["last"] else tuple(0 if r == q else _FAR for r in range(4))
        out.append(_Lattice(row["rows"], leave, bool(row["last"])).prices)
        if row["last"]:
            out = out * 4
            break
    costs = [out[r][q] for q in range(4) for r in range(4)]
    return {"conv_id": row["conv_id"], "seg": row["seg"], "last": row["last"], "costs": costs}


def _leaves(segments: pd.DataFrame) -> pd.DataFrame:
    """The prices behind every segment of one conversation, from its last one back."""
    segments = segments.sort_values("seg", ascending=False)
    price, out = _END, []
    for costs, last in zip(segments["costs"], segments["last"]):
        out.append(list(price))
        if last:
            price = tuple(int(costs[4 * q]) for q in range(4))
        else:
            price = tuple(min(_FAR, *(int(costs[4 * q + r]) + price[r] for r in range(4)))
                          for q in range(4))
    return pd.DataFrame({"conv_id": segments["conv_id"], "seg": segments["seg"], "leave": out})


def _exits(row: dict) -> dict:
    """The state behind a segment for every state before it."""
    lattice = _Lattice(row["rows"], row["leave"], bool(row["last"]))
    exits = [lattice.trace(q)[1] if lattice.prices[q] < _FAR else 0 for q in range(4)]
    return {"conv_id": row["conv_id"], "seg": row["seg"], "exits": exits}


def _entries(segments: pd.DataFrame) -> pd.DataFrame:
    """The state before every segment of one conversation."""
    segments = segments.sort_values("seg")
    state, out = 0, []
    for exits in segments["exits"]:
        out.append(state)
        state = int(exits[state])
    return pd.DataFrame({"conv_id": segments["conv_id"], "seg": segments["seg"], "entry": out})


_SOLVED = ("conv_id long, seg long, audit string, cost long, ops array<" + _OP + ">, "
           "blank long, duplicate long, truncated long, illegal long, first string, last string, "
           "low long, high long, turns long")


def _solved(row: dict) -> dict:
    """The edits of a segment between its known ends, and the counts of its faults."""
    rows, final, entry = row["rows"], bool(row["last"]), row["entry"]
    lattice = _Lattice(rows, row["leave"], final, (entry,))
    edits, state = lattice.trace(entry)
    ops, letters, parts = [], [], {}
    for i, letter, q in edits:
        # A row that is inserted behind the last one stands at the place of that row.
        at = min(i, len(rows) - 1)
        part = parts[at] = parts.get(at, -1) + 1
        new = letter in "IR"
        times = 1 if letter == "I" else rows[at]["copies"]
        ops.append({"place": rows[at]["place"], "part": part, "edit": letter, "times": times,
                    "role": _ROLE[q] if new else None})
        letters.append(letter + "D" * (times - 1))
    initials = [r["initial"] for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    count = {"blank": 0, "duplicate": 0, "truncated": 0}
    for r in rows:
        if r["fault"] == "blank":
            count["blank"] += r["copies"]
            continue
        count["duplicate"] += r["copies"] - 1
        if r["fault"]:
            count[r["fault"]] += 1
    return {"conv_id": row["conv_id"], "seg": row["seg"], "audit": "".join(letters),
            "cost": lattice.prices[entry] - (row["leave"][state] or 0), "ops": ops, **count,
            "illegal": sum(r["copies"] - 1 for r in rows) + sum(
                a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "first": initials[0], "last": initials[-1],
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
            "turns": len(set(turns))}


def matched(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; every other column of `b` is added to those of `a`."""
    b = b.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return a.join(b, condition, how).drop(*[f"_of_{k}" for k in keys])


def _with_faults(messages: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text) with `copies`, `initial` and the first `fault`."""
    space = F.lit(" ")
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    ).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    end = F.regexp_extract("text", rf"([^{BLANKS}])[{BLANKS}]*\z", 1)
    rows = rows.withColumns({
        "initial": F.substring("role", 1, 1),
        "_key": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256),
        "_end": end,
        "_when": F.struct(F.col("turn").isNotNull().alias("known"), "turn"),
    })
    # A repeated row is one of a key that has several; the earliest of these is no fault.
    firsts = rows.filter(F.col("_end") != "").groupBy("conv_id", "_key").agg(
        F.min("_when").alias("_first"), F.count("*").alias("_n")).filter(
        F.col("_n") > 1).drop("_n")
    joined = matched(rows, firsts, ["conv_id", "_key"], "left")
    fault = (F.when(F.col("_end") == "", "blank")
             .when(F.col("_when") > F.col("_first"), "duplicate")
             .when(~F.col("_end").isin(".", "!", "?"), "truncated"))
    return joined.withColumn("fault", fault).select(
        "conv_id", "turn", "role", "text", "copies", "initial", "fault")


def _segments(rows: DataFrame, segment_rows: int) -> DataFrame:
    """A row per segment: conv_id, seg, rows in order, whether it is the last, and the only, one."""
    of_one = Window.partitionBy("conv_id")
    return (
        rows.withColumn("seg", F.call_function("div", "place", F.lit(segment_rows).cast("long")))
        .groupBy("conv_id", "seg")
        .agg(F.sort_array(F.collect_list(F.struct(
            "place", "initial", "fault", "copies", "turn"))).alias("rows"))
        .withColumn("last", (F.col("seg") == F.max("seg").over(of_one)).cast("long"))
        .withColumn("only", F.min("seg").over(of_one) == F.max("seg").over(of_one))
    )


def _solve(segments: DataFrame, tables: Scratch) -> DataFrame:
    end = F.array(*[F.lit(p).cast("long") for p in _END])
    only = segments.filter("only").withColumns(
        {"leave": end, "entry": F.lit(0).cast("long")}).drop("only")
    long = segments.filter(~F.col("only")).drop("only")

    costs = long.mapInArrow(
        _mapped(_costs, "conv_id long, seg long, last long, costs array<long>"),
        "conv_id long, seg long, last long, costs array<long>")
    leaves = costs.groupBy("conv_id").applyInPandas(
        _leaves, "conv_id long, seg long, leave array<long>")
    key = ["conv_id", "seg"]
    priced = tables.table(matched(long, leaves, key))
    exits = priced.mapInArrow(_mapped(_exits, "conv_id long, seg long, exits array<long>"),
                              "conv_id long, seg long, exits array<long>")
    entries = exits.groupBy("conv_id").applyInPandas(
        _entries, "conv_id long, seg long, entry long")
    known = matched(priced, entries, key)
    return only.unionByName(known).mapInArrow(_mapped(_solved, _SOLVED), _SOLVED)


@dataclass
class Repairs:
    """The repair of a table of messages.

    `conversations`: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    `edits`: conv_id, place, part, edit (K, R, D or I), times, role (of an R or I). `place` and
    `part` order them; `times` copies of a row are one edit, all but the first copy deleted.
    `messages`: conv_id, place, turn, role, text, the rows that the edits refer to.
    """

    conversations: DataFrame
    edits: DataFrame
    messages: DataFrame


def repair(messages: DataFrame, segment_rows: int = SEGMENT_ROWS) -> Repairs:
    """The cheapest edits of every conversation; of equally cheap ones those whose initials come
    first. Results are written to the shared folder.

    Rows go by turn (nulls first), role and text. A null role or text is one space, a null conv_id one
    conversation. Repeated rows are duplicates of the first. Texts may have any length and are
    never gathered; other columns are ignored, whatever their name. An empty table gives empty
    results.
    """
    with scratch(messages.sparkSession) as tables:
        order = ["conv_id", "turn", "role", "text"]
        parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = keep(_with_faults(messages).repartitionByRange(parts, *order)
                    .sortWithinPartitions(*order)
                    .withColumn("place", F.monotonically_increasing_id()))
        segments = tables.table(_segments(rows, segment_rows))
        solved = keep(_solve(segments, tables))
    return Repairs(_summary(solved), solved.select("conv_id", F.explode("ops").alias("op")).select(
        "conv_id", "op.*"), rows.select("conv_id", "place", "turn", "role", "text"))


def _summary(solved: DataFrame) -> DataFrame:
    before = Window.partitionBy("conv_id").orderBy("seg")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    pair = F.concat(F.lag("last").over(before), F.col("first"))
    borders = solved.drop("ops").withColumns({
        "_border": F.coalesce((~pair.isin("su", "ua", "au")).cast("long"), F.lit(0)),
        "_again": F.coalesce((F.max("high").over(earlier) == F.col("low")).cast("long"), F.lit(0)),
    })
    total = borders.groupBy("conv_id").agg(
        (F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - F.col("_again"))).alias("_gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.sum(F.col("illegal") + F.col("_border")).alias("illegal"),
        F.sum("cost").alias("cost"),
        F.sort_array(F.collect_list(F.struct("seg", "audit"))).alias("_audit"),
    )
    return total.select(
        "conv_id", F.coalesce("_gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate",
        "truncated", "illegal", "cost",
        F.array_join(F.transform("_audit", lambda s: s["audit"]), "").alias("audit"))


_REPAIRED = "conv_id long, position long, role string, text string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and their edits stream by in order; a row's text is held until its edits are through."""
    conv, position, row = None, -1, None
    for batch in batches:
        out = []
        for conv_id, place, part, edit, role, text in zip(*(batch.column(i).to_pylist()
                                                            for i in range(6))):
            if position < 0 or conv_id != conv:
                conv, position = conv_id, 0
            if part < 0:
                row = (role, text)
            elif edit != "D":
                new = (role, "") if edit == "I" else (role or row[0], row[1])
                out.append((conv, position, *new))
                position += 1
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(),
                                                            pa.string()))],
                names=["conv_id", "position", "role", "text"])


def repaired_messages(repairs: Repairs) -> DataFrame:
    """The repaired conversations: conv_id, position, role, text, one conversation after the other
    inside each partition."""
    parts = int(repairs.edits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast("string")
    rows = repairs.messages.select("conv_id", "place", F.lit(-1).alias("part"), none.alias("edit"),
                                   "role", "text")
    edits = repairs.edits.select("conv_id", "place", "part", "edit", "role", none.alias("text"))
    return (rows.unionByName(edits).repartition(parts, "conv_id")
            .sortWithinPartitions("conv_id", "place", "part").mapInArrow(_apply, _REPAIRED))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(conv, digest):
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array([digest.hexdigest()], pa.string())],
            names=["conv_id", "repaired_sha256"])

    conv, digest = None, None
    for batch in batches:
        for conv_id, position, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if position == 0:
                if digest is not None:
                    yield row(conv, digest)
                conv, digest = conv_id, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
    if digest is not None:
        yield row(conv, digest)


def repaired_digests(repairs: Repairs) -> DataFrame:
    """conv_id, repaired_sha256 over `role:text` of the repaired rows, joined by newlines. Rows
    stream through the digest of their conversation; one without rows has no digest here."""
    return repaired_messages(repairs).mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
