"""Each stage on its own input, against what its operator says by brute force."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomline.llm import common, queries

STAGES = dict(corpus_pipeline.STAGES)


def test_run(spark, small):
    docs = common.table(spark, small, "documents")
    left = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, small), common.work_dir(spark))
        n = docs.count()
        assert 0 < n <= left
        left = n
        if k < len(STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in common.table(spark, small, "documents").collect()}
    rows = docs.collect()
    same = [r for r in rows if r.ids == tokens.encode(texts[r.doc_id], add_special_tokens=False).ids]
    assert len(same) >= len(rows) - 10  # others had a secret
    assert corpus_pipeline.run(spark, small).count() == left


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_stand_odd_documents(spark, odd_docs, small, name):
    out = STAGES[name](spark, odd_docs, small)
    assert out.count() <= odd_docs.count()
    if name != "byte-pair encoding":
        assert out.columns == odd_docs.columns
    assert STAGES[name](spark, odd_docs.limit(0), small).count() == 0


def test_near_duplicates_keep_one_of_each_group(spark, odd_docs, small):
    got = sorted(str(r.doc_id) for r in STAGES["near duplicates"](spark, odd_docs, small).collect())
    want = [r.doc_id for r in odd_docs.collect() if r.doc_id not in (7, 8, 14)]
    assert got == sorted(map(str, want))


def test_queries_run_on_whole_tables(spark, small):
    sizes = {t: common.table(spark, small, t).count() for t in ("documents", "pages")}
    for name, table in (("op1_token_counts", "documents"), ("op2_secret_scan", "documents"), ("op6_html_text", "pages"), ("op8_token_files", "documents")):
        assert queries.QUERIES[name](spark, small).count() == sizes[table]
