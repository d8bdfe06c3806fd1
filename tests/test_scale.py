"""What retrieval must not do twice or shuffle whole."""

from quillstone.operators import index, lexical
from quillstone.plans import search


def test_counts_of_terms_without_a_shuffle(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b a b c"), (2, ""), (3, None), (4, "a")], "doc_id long, text string")
    payload = lexical.tokenised(docs)
    found = lexical.term_counts(payload)
    assert sorted(map(tuple, found.collect())) == [("a", 1, 1, 4), ("a", 4, 1, 1), ("b", 1, 2, 4), ("c", 1, 1, 4)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    index.build(docs.selectExpr("doc_id", "text", "'x' as code", "array(1f) as embedding"), f"{tmp_path}/index")
    assert index.load(spark, f"{tmp_path}/index").statistics.size.first() == lexical.corpus_size(payload).first()


def test_the_grid_ranks_all_documents_once_a_round(spark, monkeypatch):
    calls, real = [], lexical.padded_best
    monkeypatch.setattr(lexical, "padded_best", lambda *a: calls.append(1) or real(*a))
    assert search.ablation_grid(spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 2
