"""Conversation repair against a plain dynamic program over whole conversations."""

import hashlib
import random

import pytest

from tidemark.llm import conversation_repair as cr

FITS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
GROWS = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen
                   else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def model(rows):
    """(cost, audit, repaired lines) of rows in order."""
    def inserted(v):
        out = dict(v)
        for q, (to, role) in GROWS.items():
            if to in v:
                cost, audit, lines = v[to]
                new = (cost + 5, "I" + audit, [f"{role}:", *lines])
                if q not in out or new[:2] < out[q][:2]:
                    out[q] = new
        return out

    best = inserted(inserted({0: (0, "", []), 3: (0, "", [])}))
    for (role, text), fault in reversed(list(zip(rows, faults(rows)))):
        now = {}

        def offer(q, cost, letter, to, line):
            if to in best:
                rest = best[to]
                new = (cost + rest[0], letter + rest[1], ([line] if line else []) + rest[2])
                if q not in now or new[:2] < now[q][:2]:
                    now[q] = new
        for q in range(4):
            offer(q, 2, "D", q, None)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                if (q, role[:1]) in FITS:
                    offer(q, more, "K", FITS[q, role[:1]], f"{role}:{text}")
                offer(q, more + 1, "R", GROWS[q][0], f"{GROWS[q][1]}:{text}")
        best = inserted(inserted(now))
    return best[0]


def expected(messages):
    """conv_id -> the values of the query, from (conv_id, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in messages:
        groups.setdefault(conv, []).append(
            (turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        plain = [(role, text) for _, role, text in rows]
        cost, audit, lines = model(plain)
        turns = {t for t, _, _ in rows if t is not None}
        found = faults(plain)
        initials = [role[:1] for role, _ in plain]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[found.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest() if lines else None)
    return out


def found(spark, messages, **options):
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    repairs = cr.repair(df, **options)
    digests = {r["conv_id"]: r["repaired_sha256"] for r in cr.repaired_digests(repairs).collect()}
    rows = repairs.conversations.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"],
                           r["cost"], r["audit"], digests.get(r["conv_id"])) for r in rows}


def noise(seed, conversations, longest, texts=("a.", "b!", "c", "", " \t", "d?", "e. ", "f\n")):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "unit", None]
    return [(conv, rng.choice([t, t, t, 0, None, t + 3]), rng.choice(roles),
             rng.choice([*texts, f"{conv} {t}.", f"{conv} {t}", None]))
            for conv in range(conversations) for t in range(rng.randrange(longest))]


def test_lattice_equals_dynamic_program():
    rng = random.Random(1)
    for _ in range(1_500):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]),
                 rng.choice(["x.", "y", "", f"{i}!", f"{i}.", f"{i}"]))
                for i in range(rng.randrange(80))]
        units = [{"initial": role[:1], "fault": fault, "copies": 1}
                 for (role, _), fault in zip(rows, faults(rows))]
        cost, edits = cr.cheapest_edits(units)
        want = model(rows)
        assert (cost, "".join(e[1] for e in edits)) == want[:2]


@pytest.mark.parametrize("segment_rows", [1, 3, 1024])
def test_conversations_cut_anywhere(spark, segment_rows):
    messages = noise(segment_rows, 40, 14) + [
        (None, t, random.Random(t).choice(["user", "assistant", "system"]), f"{t}.")
        for t in range(150)]
    assert found(spark, messages, segment_rows=segment_rows) == expected(messages)


def test_repeated_rows_count_by_copies(spark):
    messages = [(1, 5, "user", "same.")] * 7 + [(1, 6, "assistant", "")] * 4 + [
        (1, 6, "assistant", "yes.")] * 2 + [(2, 0, "user", "same.")]
    got = found(spark, messages, segment_rows=2)
    assert got == expected(messages)
    assert got[1][1:4] == (4, 7, 0)


def test_long_texts_and_other_columns(spark):
    rows = [(1, 0, "user", "x " * 400_000 + "!"), (1, 1, "assistant", "y" * 300_000),
            (1, 2, "assistant", " " * 200_000 + ".")]
    df = spark.createDataFrame([(*r, "z", 7, 8) for r in rows],
                               "conv_id long, turn long, role string, text string, place string, "
                               "_key int, seg int")
    repairs = cr.repair(df)
    assert repairs.conversations.first()["audit"] == expected(rows)[1][6]
    assert [(r["role"], len(r["text"])) for r in cr.repaired_messages(repairs).orderBy(
        "position").collect()] == [("user", 800_001), ("assistant", 200_001)]


def test_empty_table_and_nothing_left(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, None, None, None), (2, 3, "user", "")]) == expected(
        [(1, None, None, None), (2, 3, "user", "")])
