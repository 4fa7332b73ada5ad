"""Operators and pipeline stages on documents whose columns are named like the operators' helpers."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    chat, conversation_repair, decontamination, exact_dedup, html_text, line_dedup, mixing,
    ngram_join, personal_data, quality, token_counts, toxicity,
)

NAMES = ["_id", "_lower", "_score", "rank", "_size", "n_removed", "n_lines", "_n_removed", "_order",
         "_start", "_slice", "_stream", "_before", "_whole", "_version", "_removed", "_several",
         "_gone", "_n", "_hi", "_lo", "row", "at", "h", "host", "number", "start", "part", "_c0",
         "w", "term", "seg", "place", "Position_", "keep", "r"]


def named(spark, columns, rows):
    df = spark.createDataFrame(rows, columns)
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES
                            if n.lower() not in [c.lower() for c in df.columns]])


@pytest.fixture(scope="module")
def docs(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away home"
    rows = [(1, f"{text}\nshared line", "en", "a", 0), (2, f"{text}\nshared line", "en", "b", 0),
            (3, "what is the capital of the far land? it is a small town by the sea shore", "en", "a", 0),
            (4, None, None, None, None), (None, "another text altogether", "en", "c", 0), (5, "", "", "", 0)]
    return named(spark, "doc_id long, text string, lang string, source string, n_chars long", rows)


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame(
        [(7, "what is the capital of the far land? it is a small town by the sea shore")],
        "item_id long, text string")
    return labels, bench


def own(df, but=()):
    for n in NAMES:
        if n not in but:
            assert {r[0] for r in df.select(f"`{n}`").collect()} <= {f"own {n}"}, n


def test_operators_keep_the_columns(docs, tables):
    labels, bench = tables
    own(quality.with_quality(docs, labels, column="_score_"))
    own(line_dedup.remove_spread_lines(docs, min_sites=2), ("n_removed", "n_lines"))
    own(ngram_join.one_per_component(docs))
    clean = decontamination.without_leaks(docs, bench)
    own(clean)
    assert clean.columns == docs.columns and clean.count() == 5
    own(mixing.mix(docs))
    own(personal_data.sanitise(docs))


def test_operators_ignore_the_columns(docs, tables):
    labels, bench = tables
    assert decontamination.find_leaks(docs, bench).count() == 1
    assert exact_dedup.exact_duplicates(docs).count() == 6
    assert mixing.shares(docs).count() == 6
    assert toxicity.toxicity_scores(docs, labels).count() == 6
    assert quality.quality_scores(docs, labels).count() == 6
    assert ngram_join.ngram_components(docs).count() == 6
    public_tokenizers = pytest.importorskip("public_tokenizers")
    assert token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 6


def test_pages_and_messages(spark):
    pages = named(spark, "page_id long, url string, html string",
                  [(1, "http://a.org/x", "<article><p>one</p></article>"), (2, None, None)])
    assert {r["text"] for r in html_text.extract_text(pages).collect()} == {"one", ""}
    messages = named(spark, "conv_id long, turn long, role string, text string",
                     [(1, 0, "user", "a."), (1, 1, "assistant", "b.")])
    assert chat.conversation_digests(chat.format_messages(messages)).count() == 1
    assert conversation_repair.repair(messages).conversations.first()["audit"] == "KK"


def test_pipeline_keeps_the_columns(spark, docs, tables, tmp_path):
    labels, bench = tables
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    own(out)
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, function) in enumerate(corpus_pipeline.STAGES[:-1]):
        result = function(spark, stage, str(tmp_path))
        assert result.columns == docs.columns
        result.write.parquet(f"{tmp_path}/stage{i}")
        stage = spark.read.parquet(f"{tmp_path}/stage{i}")
