import numpy as np
import pytest

import brute
from tidemark.llm import exact_dedup

SCHEMA = "doc_id long, text string, key string, n int"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)


def plain(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(brute.LOWER), []).append(d)
    return sorted((d, max(groups[x]), len(groups[x]), d == max(groups[x]), brute.sha(x))
                  for d, t in rows for x in [(t or "").translate(brute.LOWER)])


@pytest.mark.parametrize("key_bits, capacity", [(64, 4096), (64, 3), (3, 2), (1, 1)])
def test_equals_plain_model_also_with_collisions(spark, key_bits, capacity):
    texts = ["a", "A", "b", "", None, "É", "é", "x" * 100_000, "X" * 100_000, "a ", "a\n"]
    rows = list(enumerate(texts * 7 + [f"text {i % 20}" for i in range(150)]))
    out = exact_dedup.exact_duplicates(table(spark, rows).repartition(5), capacity, key_bits)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, out.collect())) == plain(rows)


def test_one_of_several_equal_rows_is_kept(spark):
    rows = [(1, "a"), (2, "A"), (2, "a"), (None, "a"), (None, "z"), (None, "Z")]
    got = exact_dedup.exact_duplicates(table(spark, rows)).collect()
    kept = [(r.doc_id, r.keep_id, r.group_size) for r in got if r.kept]
    assert sorted(kept, key=str) == [(2, 2, 4), (None, None, 2)]
    assert len(got) == 6


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0


def test_directory_doubles_only_where_buckets_are_overfull(spark):
    rng = np.random.default_rng(0)
    wide = rng.integers(-2 ** 63, 2 ** 63, 500)
    narrow = rng.integers(2 ** 62, 2 ** 62 + 2 ** 56, 500)
    same = np.full(300, 17)
    keys = np.concatenate([wide, narrow, same])
    frame = spark.createDataFrame([(int(k),) for k in keys], "key long")
    directory = exact_dedup.build_directory(frame, 64)
    depth = int(np.log2(len(directory)))
    slot = (keys.astype(np.uint64) + np.uint64(1 << 63)) >> np.uint64(64 - depth)
    sizes = np.bincount(directory[slot.astype(int)])
    crowded = directory[int((17 + (1 << 63)) >> (64 - depth))]
    assert sizes[crowded] >= 300  # equal keys cannot be split
    assert np.delete(sizes, crowded).max() <= 64
    assert (np.diff(directory) >= 0).all() and len(directory) == 1 << depth
    # Buckets of the sparse ranges have several directory entries, those of the dense one few.
    entries = np.bincount(directory)
    assert entries.max() > entries.min()
    placed = frame.select("key", exact_dedup.bucket_of(directory).alias("b")).collect()
    assert [r.b for r in placed] == directory[slot.astype(int)].tolist()
