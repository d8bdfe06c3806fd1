import pytest
from pyspark.sql import functions as F

from quillstone.functions import constants as C
from quillstone.operators import dense, index, lexical, retrieval


def _fuse(spark, rows, k=6):
    df = spark.createDataFrame(rows, "qid int, doc_id int, route string, rank int, vec_score double, bm_score double")
    return {r.doc_id: r for r in retrieval.fuse(df, ["qid"], k).collect()}


def test_rrf_of_both_routes(spark):
    got = _fuse(spark, [(1, 7, "vector", 1, 0.9, 3.0), (1, 7, "bm25", 4, 0.9, 3.0)])
    assert abs(got[7].rrf - (1 / 61 + 1 / 64)) < 1e-8


def test_two_middling_ranks_beat_one_good(spark):
    got = _fuse(spark, [(1, 1, "vector", 5, 0.1, 0.0), (1, 1, "bm25", 6, 0.1, 0.0), (1, 2, "vector", 3, 0.9, 0.0)])
    assert got[1].place == 1 and abs(got[1].rrf - 0.030536130) < 1e-8 and abs(got[2].rrf - 0.015873016) < 1e-8


def test_equal_rrf_goes_to_the_higher_vector_score(spark):
    got = _fuse(spark, [(1, 1, "vector", 1, 0.2, 0.0), (1, 2, "bm25", 1, 0.5, 9.0)])
    assert got[2].place == 1


def test_zero_scores_fill_a_pool(spark):
    scores = spark.createDataFrame([], "qid int, doc_id int, score double")
    pads = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "qid int, doc_id int")
    got = lexical.padded_best(scores, pads, 2, "qid").orderBy("rank").collect()
    assert [(r.doc_id, r.score, r["rank"]) for r in got] == [(0, 0.0, 1), (1, 0.0, 2)]


def test_entity(spark):
    df = spark.createDataFrame([("中国银行和工行",), ("兴业与600036",), ("平安中信",), ("nothing",)], "t string")
    got = [r.e and r.e.code for r in df.select(retrieval.detect_entity(F.col("t")).alias("e")).collect()]
    # The longest alias; a code before any alias; of equal lengths the larger code; none.
    assert got == ["601988", "600036", "601998", None]


def test_expansion(spark):
    df = spark.createDataFrame([("净息差是多少",), ("净息差与净利差",), ("别的",)], "t string")
    added = retrieval.expansion(F.col("t"))
    rows = df.select(added.alias("a"), retrieval.expanded(F.col("t"), added).alias("e")).collect()
    assert rows[0].a == ["净利息收益率", "净利差", "NIM"] and rows[0].e == "净息差是多少（净利息收益率、净利差、NIM）"
    assert rows[1].a == ["净利息收益率", "NIM"]
    assert rows[2].a == [] and rows[2].e == "别的"


def test_backstop_round(spark):
    """A company pool of two: both come first, tagged twice where the global round has them, then others."""
    e = [1.0, 0.0]
    docs = spark.createDataFrame(
        [(i, "word" if i != 3 else "other", "a" if i < 2 else "b", e if i != 1 else [0.0, 1.0]) for i in range(9)],
        "doc_id long, text string, code string, embedding array<float>",
    )
    asked = spark.createDataFrame([(5, "word", e, "a")], "qid long, text string, embedding array<float>, code string")
    got = retrieval.HybridIndex(docs).retrieve(asked, top=6).orderBy("place").collect()
    assert {r.doc_id for r in got[:2]} == {0, 1} and len({r.doc_id for r in got}) == 6
    assert all(r.source == "company" and r.n_returned == 2 for r in got[:2])
    assert got[0].rounds == "company+global" and all(r.rounds == "global" for r in got[2:])


def test_constants_are_parameters():
    assert (C.RRF_K, C.ROUTE_DEPTH, C.TOP) == (60, 10, 6)


def _corpus(spark, n=40):
    rows = [(k, f"common word{k % 7} term{k}" + " rare" * (k == 5), f"c{k % 3}", [1.0, k / n] if k % 4 else None) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, code string, embedding array<float>")


def test_stored_index_answers_as_the_corpus_does(spark, tmp_path):
    corpus = _corpus(spark)
    index.build(corpus, f"{tmp_path}/index")
    stored, fresh = index.load(spark, f"{tmp_path}/index"), retrieval.HybridIndex(corpus)
    asked = spark.createDataFrame([(1, "rare term8 common", [1.0, 0.2], "c2"), (2, "word3", [0.0, 1.0], None)], "qid long, text string, embedding array<float>, code string")
    for mode in retrieval.MODES:
        rows = [sorted(map(tuple, x.retrieve(asked, mode).select("qid", "place", "doc_id", "vec_score", "bm_score", "rounds").collect()), key=repr) for x in (stored, fresh)]
        assert rows[0] == rows[1] and len(rows[0]) == 12
    # A document without a vector is found by its words.
    assert stored.search(asked.where("qid = 1"), "bm25").where("doc_id = 8").first().vec_score is None
    assert stored.search(asked, "vector").join(corpus.where("embedding is null"), "doc_id").count() == 0


def test_index_of_other_counts_is_an_error(spark, tmp_path):
    index.build(_corpus(spark), f"{tmp_path}/index")
    _corpus(spark, 39).select("doc_id", "code", "text", "embedding").write.mode("overwrite").parquet(f"{tmp_path}/index/docs")
    with pytest.raises(ValueError, match="39 documents"):
        index.load(spark, f"{tmp_path}/index")


def test_encoding_carries_on(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "ccc")], "doc_id long, text string")
    done = spark.createDataFrame([(1, [9.0])], "doc_id long, embedding array<float>")
    got = index.encode_missing(docs, done, lambda texts: [[float(len(t))] for t in texts], block=1).collect()
    assert {r.doc_id: r.embedding for r in got} == {2: [0.0], 3: [3.0]}


def test_passages_word_for_word(spark):
    rows = [(1, "see: the odd-looking fox ran."), (2, "the odd looking fox"), (3, "bathe odd-looking foxes"), (4, "xodd-looking")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    passages = spark.createDataFrame([(1, "the odd-looking fox"), (2, "odd"), (3, "never there at all"), (4, "odd-l")], "qid long, text string")
    got = sorted(map(tuple, lexical.containing(docs, lexical.statistics(lexical.tokenised(docs)), passages).collect()))
    assert got == [(q, d, t.index(p) + 1) for q, p in ((1, "the odd-looking fox"), (2, "odd"), (4, "odd-l")) for d, t in rows if p in t]


def test_best_vectors_with_ties(spark):
    rows = [(k, [1.0, 0.0] if k % 3 else [0.0, 1.0], "p" if k % 2 else "q") for k in range(200)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<float>, pool string").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.0], "p"), (2, [0.0, 1.0], "none")], "qid long, embedding array<float>, pool string")
    got = [r.doc_id for r in dense.vector_topk(vectors, asked, 5).where("qid = 1").orderBy("rank").collect()]
    assert got == [1, 2, 4, 5, 7]
    inside = dense.vector_topk(vectors, asked, 5, "pool").orderBy("rank").collect()
    assert [(r.qid, r.doc_id) for r in inside] == [(1, 1), (1, 5), (1, 7), (1, 11), (1, 13)]
