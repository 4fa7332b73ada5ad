from tidemark.llm import line_dedup

SCHEMA = "doc_id long, text string, source string, n_lines string, h int"


def run(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = line_dedup.remove_spread_lines(frame, **options)
    assert out.columns == ["doc_id", "text", "source", "h", "n_lines", "n_removed"]
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)


def test_lines_on_many_sites_stay_at_their_first_place_only(spark):
    rows = [(i, f"own {i}\n  Share this \r\n\nmore {i}", f"site{i}") for i in range(12)]
    rows += [(20 + i, "Same site line\nshare this", "site1") for i in range(30)]
    got = run(spark, rows, min_sites=10)
    assert got[:2] == [(0, rows[0][1], 3, 0), (1, "own 1\n\nmore 1", 3, 1)]
    assert (20, "Same site line\nshare this", 2, 0) in got


def test_threshold_is_exact_near_it(spark):
    rows = [(i * 100 + s, f"line {i}\nx{i}-{s}", f"s{s}") for i in range(5, 16) for s in range(i)]
    rows += [(9000 + s, f"line 9\ny{s}", "s1") for s in range(40)]
    got = {d: n for d, _, _, n in run(spark, rows, min_sites=10)}
    for i in range(5, 16):
        assert sum(got[i * 100 + s] for s in range(i)) == (i - 1 if i >= 10 else 0)


def test_special_rows(spark):
    rows = [(None, "b", None), (1, None, "a"), (2, "", "a"), (3, "\n \n", "a"), (4, "b\nb", "s4"),
            (4, "b\nb", "s4"), (5, "b", "s5"), (6, "b" + "c" * 200_000, "s6")]
    got = run(spark, rows, min_sites=3)
    assert got == sorted([
        (None, "b", 1, 0), (1, None, 0, 0), (2, "", 0, 0), (3, "\n \n", 0, 0), (4, "", 2, 2),
        (4, "", 2, 2), (5, "", 1, 1), (6, "b" + "c" * 200_000, 1, 0)], key=str)
    # The first place of a line stays in all rows that repeat it.
    rows = [(4, "b\nb", "s4"), (4, "b\nb", "s4"), (5, "b", "s5"), (6, "b", "s6")]
    assert run(spark, rows, min_sites=3) == [(4, "b", 2, 1), (4, "b", 2, 1), (5, "", 1, 1),
                                             (6, "", 1, 1)]
    assert run(spark, []) == []


def test_plan_has_no_python(spark):
    frame = spark.createDataFrame([(1, "a\nb", "s")], "doc_id long, text string, source string")
    plan = line_dedup.remove_spread_lines(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
