import math

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.mixing import Curriculum

SCHEMA = "doc_id long, text string, source string, size string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def corpus():
    rows = [(i, "w " * (1 + i * 37 % 90), f"s{i % 4}") for i in range(400)]
    rows += [(1000 + i, "w " * 5, "tiny") for i in range(3)] + [(2000, "w " * 900, "Big")]
    return rows + [(3000 + i, "word " * 10, None) for i in range(20)] + [(4000, None, "s1"),
                                                                           (4001, "", "void")]


def targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [
        s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        now = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if now[s] > 2 * sizes[s]}
        if not above:
            return now | {s: 2 * sizes[s] for s in capped}
        capped |= above


def test_taken_words_meet_the_targets(spark):
    rows = corpus()
    got = mixing.shares(table(spark, rows)).collect()
    sizes, taken, target = {}, {}, {}
    source = {d: s for d, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.size == len(brute.words({d: t for d, t, _ in rows}[r.doc_id]))
        assert 0 <= r.taken <= 2 * r.size
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
    want = targets(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-12, abs_tol=1e-9)
        assert target[s] - 1 < taken[s] <= target[s]


def test_reruns_and_partitions_do_not_matter(spark):
    rows = corpus()
    one = mixing.shares(table(spark, rows).coalesce(1)).collect()
    many = mixing.shares(table(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(one) == sorted(many)


def test_slices_give_the_same_mix(spark, monkeypatch):
    rows = corpus()
    one = sorted(mixing.shares(table(spark, rows)).collect())
    monkeypatch.setattr(mixing, "ROWS_PER_SLICE", 5)
    assert sorted(mixing.shares(table(spark, rows)).collect()) == one


def test_mix_is_in_order_of_position_and_keeps_columns(spark):
    rows = corpus()
    out = mixing.mix(table(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "rank", "size", "source_size", "target", "copy",
                           "position", "taken"]
    got = out.collect()
    assert [r.position for r in got] == sorted(r.position for r in got)
    assert all(0 <= r.position <= 1 for r in got)
    total = sum(len(brute.words(t)) for _, t, _ in rows)
    assert abs(sum(r.taken for r in got) - 1.5 * total) < 10
    share = {r.doc_id: r.taken for r in mixing.shares(table(spark, rows)).collect()}
    by = {}
    for r in got:
        by[r.doc_id] = by.get(r.doc_id, 0) + r.taken
    assert by == {d: n for d, n in share.items() if n}


def test_schedule_moves_a_source_in_time(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(2000)]
    early = ((0.0, 2.0), (0.5, 1.0), (1.0, 0.0))
    out = mixing.mix(table(spark, rows), Curriculum(
        weights=(1,), schedules=(early, ((0.0, 1.0), (1.0, 1.0)))))
    thirds = {}
    for r in out.collect():
        thirds.setdefault(r.source, [0, 0, 0, 0])[min(3, int(r.position * 4))] += r.taken
    a, b = thirds["a"], thirds["b"]
    # Areas of the falling line over the quarters: 7, 5, 3 and 1 sixteenths.
    assert [round(16 * x / sum(a)) for x in a] == [7, 5, 3, 1]
    assert [round(16 * x / sum(b)) for x in b] == [4, 4, 4, 4]


@pytest.mark.parametrize("schedule", [((0.0, 0.0), (1.0, 2.0)), ((0.0, 1.0), (0.3, 0.0), (1.0, 3.0)),
                                      ((0.0, 1.0), (1.0, 1.0))])
def test_position_inverts_the_integral(spark, schedule):
    def area(x):
        out = 0.0
        for (t0, l0), (t1, l1) in zip(schedule, schedule[1:]):
            u = min(max(x - t0, 0), t1 - t0)
            out += u * (l0 + (l1 - l0) * u / (t1 - t0) / 2)
        return out

    got = spark.range(101).select((F.col("id") / 100).alias("q"), mixing.position(
        F.col("id") / 100, schedule).alias("x")).collect()
    for r in got:
        assert math.isclose(area(r.x), r.q * area(1.0), abs_tol=1e-9)


def test_ties_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c", "s")] * 4 + [(None, "a b", "s"), (None, "a", None)]
    got = mixing.shares(table(spark, rows)).collect()
    assert len(got) == 6 and sum(r.taken for r in got) == int(1.5 * 15)
    assert mixing.shares(table(spark, [])).count() == 0
    assert mixing.mix(table(spark, [])).count() == 0
    assert mixing.mix(table(spark, [(1, None, "s"), (2, "", None)])).count() == 0
