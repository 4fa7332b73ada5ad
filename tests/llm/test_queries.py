"""Every registered training-data query, against its check SQL where there is one."""

import pytest

import __spark_entry__ as entry
import brute
from compare import compare, connect
from tidemark.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_check(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER),
                   queries.CHECKS[name]) is None


def test_decontamination_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    want = set()
    for d, text in docs.items():
        have = brute.gram_set(text, 5)
        for i, item in items.items():
            grams = brute.gram_set(item, 5)
            if len(grams & have) >= 0.8 * len(grams):
                want.add((d, i))
    got = {(r.doc_id, r.item_id)
           for r in queries.QUERIES["op1_benchmark_decontamination"](spark, FOLDER).collect()}
    assert got == want


def test_token_counts_equal_the_library(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in
             spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries.QUERIES["op7_token_counts"](spark, FOLDER).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_pages_give_their_articles(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in queries.QUERIES["op8_html_extraction"](spark, FOLDER).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", x)).split())
                  for x in re.split(r"</?(?:p|h1|br)>", article))
        assert r.text == "\n".join(b for b in blocks if b)
