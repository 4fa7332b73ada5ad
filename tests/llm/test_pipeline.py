import pytest

import brute
import corpus_pipeline
from tidemark.llm.quality import features

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_return_the_columns_of_documents(results):
    for df in results[1:-1]:
        assert df.dtypes == results[0].dtypes


def test_quality_rejects_what_is_labelled_low(spark, results):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = set(ids(results[1]))
    right = [(d in kept) == bool(y) for d, y in labels.items()]
    assert sum(right) > 0.97 * len(right)


def test_line_dedup_stage(results):
    before = {r.doc_id: r.text for r in results[1].collect()}
    after = {r.doc_id: r for r in results[2].collect()}
    sites, first = {}, {}
    source = {r.doc_id: r.source for r in results[1].collect()}
    for d in sorted(before):
        for i, line in enumerate((before[d] or "").split("\n")):
            line = line.strip(" \t\r")
            sites.setdefault(line, set()).add(source[d])
            first.setdefault(line, (d, i))
    for d, text in before.items():
        left = [x for i, x in enumerate(text.split("\n")) if not x.strip(" \t\r")
                or len(sites[x.strip(" \t\r")]) < 10 or first[x.strip(" \t\r")] == (d, i)]
        if any(x.strip(" \t\r") for x in left) or not text.strip():
            assert after[d].text == "\n".join(left) and after[d].n_chars == len(after[d].text)
        else:
            assert d not in after


def test_near_duplicate_stage(results):
    rows = [(r.doc_id, r.text) for r in results[2].collect()]
    want = sorted(d for d, _, c in brute.components(rows, 5, 80) if d == c)
    assert ids(results[3]) == want


def test_decontamination_stage(spark, results):
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    grams = [brute.gram_set(t, 5) for t in items]
    leaks = {r.doc_id for r in results[3].collect()
             if any(len(g & brute.gram_set(r.text, 5)) >= 0.8 * len(g) for g in grams)}
    assert leaks and set(ids(results[4])) == set(ids(results[3])) - leaks


def test_mixing_stage_takes_the_share(results):
    total = sum(len(brute.words(r.text)) for r in results[4].collect())
    taken = sum(r.taken for r in results[5].collect())
    assert abs(taken - 1.5 * total) < 50
    assert set(results[4].columns) < set(results[5].columns)


def test_run_on_a_small_folder(spark, results, tmp_path):
    docs = spark.createDataFrame(
        [(1, "plain words of some text here", None, "s", 9, "x"), (None, None, None, None, None, "x"),
         (2, "", "en", "s", 0, "y")],
        "doc_id long, text string, lang string, source string, n_chars long, n_removed string")
    for rows, name in ((docs, "some"), (docs.limit(0), "none")):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
            f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "not in there at all")], "item_id long, text string").write.parquet(
            f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert "n_removed" in out.columns
        out.collect()


def test_features_of_nothing():
    import pyarrow as pa

    assert len(features(pa.array(["", None]), 10)[0]) == 0
