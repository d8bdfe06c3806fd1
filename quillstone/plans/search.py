"""Retrieval queries over documents, vectors and benchmark questions, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import constants as C
from quillstone.functions.text import citation, tokens
from quillstone.operators import answering, dense, index, lexical, retrieval
from quillstone.sources import table
from quillstone.sources.shared import file_state, shared_dir

#: The catalog of the test data: sources are the entities.
ENTITIES = [(f"src{k}", f"Source {k}", [f"source number {k}", f"s-{k}"]) for k in range(20)]
SYNONYMS = [("thing", ["object", "item"]), ("tion", ["act", "thing"]), ("mente", ["modo"]), ("heit", ["zustand", "lage"])]


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _one(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).where("qid = 2")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with a vector and, for most, a source named in their text."""
    vectors = _vectors(spark, sf).select(F.col("doc_id").alias("qid"), "embedding")
    named = F.when(F.col("qid") % 4 != 0, F.concat(F.lit(" src"), (F.col("qid") % 20).cast("string"))).otherwise("")
    q = _questions(spark, sf).select("qid", F.concat("text", named).alias("text")).join(vectors, "qid")
    return q.withColumn("code", retrieval.detect_entity(F.col("text"), ENTITIES)["code"])


_STORED: dict[tuple, str] = {}


def _index(spark: SparkSession, sf: str) -> retrieval.HybridIndex:
    """The index of all documents, stored in the shared folder once for a state of its tables."""
    state = tuple(file_state(spark, f"{sf}/{name}.parquet") for name in ("documents", "embeddings"))
    key = (spark.sparkContext.applicationId, sf, state)
    if key not in _STORED:
        docs = _docs(spark, sf).select("doc_id", "text", F.col("source").alias("code"))
        folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        index.build(docs.join(_vectors(spark, sf).select("doc_id", "embedding"), "doc_id", "left"), folder)
        _STORED[key] = folder
    return index.load(spark, _STORED[key])


def tokens_per_doc(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"))


def doc_freq(spark, sf):
    return lexical.document_frequencies(lexical.term_frequencies(lexical.tokenised(_docs(spark, sf))))


def idf_floor(spark, sf):
    return _index(spark, sf).statistics.terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_scores(spark, sf):
    docs = _docs(spark, sf)
    scored = lexical.bm25(_index(spark, sf).statistics, _one(spark, sf))
    return docs.select("doc_id").join(scored, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _bm25_best(spark, sf, questions, k):
    docs = _docs(spark, sf)
    scored = lexical.bm25(_index(spark, sf).statistics, questions)
    first = docs.select("doc_id").orderBy("doc_id").limit(2 * k)
    return lexical.padded_best(scored, questions.select("qid").join(F.broadcast(first)), k, "qid")


def bm25_top10(spark, sf):
    return _bm25_best(spark, sf, _one(spark, sf), 10).select("doc_id", "score", "rank")


def bm25_batch_topk(spark, sf):
    return _bm25_best(spark, sf, _questions(spark, sf), 10).select("qid", "doc_id", "score", "rank")


def vector_norms(spark, sf):
    return _vectors(spark, sf).select(dense.norm("embedding").alias("n")).agg(
        F.count(F.lit(1)).alias("vectors"), F.round(F.min("n"), 5).alias("least"), F.round(F.max("n"), 5).alias("most")
    )


def _queries(spark, sf, where):
    return _vectors(spark, sf).where(where).select(F.col("doc_id").alias("qid"), "embedding", "label")


def vector_topk(spark, sf):
    return dense.vector_topk(_vectors(spark, sf), _queries(spark, sf, "doc_id = 0"), 10).select("doc_id", "score", "rank")


def vector_batch_topk(spark, sf):
    return dense.vector_topk(_vectors(spark, sf), _queries(spark, sf, "doc_id % 20 = 0"), 10)


def vector_topk_in_pool(spark, sf):
    return dense.vector_topk(_vectors(spark, sf), _queries(spark, sf, "doc_id % 20 = 0"), 10, "label")


def rrf_fuse(spark, sf):
    return _index(spark, sf).search(_asked(spark, sf), "hybrid", 20).select("qid", "place", "doc_id", "vec_rank", "bm_rank", "rrf")


def _search(mode):
    def query(spark, sf):
        return _index(spark, sf).search(_asked(spark, sf), mode).select("qid", "place", "doc_id", "vec_rank", "bm_rank", "vec_score", "bm_score")

    return query


def rrf_k_sweep(spark, sf):
    routes = _index(spark, sf).routes(_asked(spark, sf), "hybrid", 6)
    ks = spark.createDataFrame([(k,) for k in (1, 3, 5, 10, 20, 60, 200)], "k int")
    merged = routes.join(F.broadcast(ks)).groupBy("k", "qid", "doc_id").agg(
        F.round(F.sum(1.0 / (F.col("k") + F.col("rank"))), 9).alias("rrf"), F.max("vec_score").alias("v"),
        F.max(F.when(F.col("route") == "vector", F.col("rank"))).alias("vr"),
    )
    order = Window.partitionBy("k", "qid").orderBy(F.desc("rrf"), F.desc("v"), F.asc_nulls_last("vr"), "doc_id")
    return merged.withColumn("place", F.row_number().over(order)).where("place <= 6").select("k", "qid", "place", "doc_id", "rrf")


def mode_diff(spark, sf):
    """Documents that one route alone has among its best six."""
    routes = _index(spark, sf).routes(_asked(spark, sf), "hybrid", 6).where("rank <= 6")
    found = routes.groupBy("qid", "doc_id").agg(F.collect_set("route").alias("r"))
    return found.where(F.size("r") == 1).select("qid", "doc_id", F.col("r")[0].alias("only"))


def detect_entity(spark, sf):
    found = retrieval.detect_entity(F.col("text"), ENTITIES)
    return _asked(spark, sf).drop("code").select("qid", found.alias("e")).select("qid", F.col("e.code").alias("code"), F.col("e.name").alias("name"))


def expand_query(spark, sf):
    added = retrieval.expansion(F.col("text"), SYNONYMS)
    return _questions(spark, sf).select("qid", F.array_join(added, ",").alias("added"), retrieval.expanded(F.col("text"), added).alias("expanded"))


def two_round_retrieve(spark, sf):
    found = _index(spark, sf).retrieve(_asked(spark, sf))
    return found.select("qid", "place", "doc_id", "rounds", "source", "vec_rank", "bm_rank", "n_returned")


def company_pool_topk(spark, sf):
    stored = _index(spark, sf)
    routes = stored.routes(_asked(spark, sf), "hybrid", 6, ("company",))
    return retrieval.fuse(routes, ["qid"], 6).select("qid", "place", "doc_id", "vec_rank", "bm_rank")


def ablation_grid(spark, sf):
    """Hits of the question's source among the best six, for every mode with and without the company round."""
    asked, stored = _asked(spark, sf), _index(spark, sf)
    routes = retrieval.stored(stored.routes(asked, "hybrid", C.TOP, ("company", "global")))
    out = None
    for mode in retrieval.MODES:
        for own in (True, False):
            hits = stored.retrieve(asked, mode, company_filter=own, routes=routes).join(stored.codes, "doc_id")
            counted = hits.join(asked.select("qid", F.col("code").alias("target")).where("target is not null"), "qid").groupBy("qid").agg(
                F.count_if(F.col("code") == F.col("target")).alias("n_hit")
            ).select(F.lit(mode).alias("mode"), F.lit(own).alias("company_filter"), "qid", "n_hit")
            out = counted if out is None else out.unionByName(counted)
    return out


def cite_format(spark, sf):
    docs = _docs(spark, sf)
    first = (F.col("doc_id") % 7 + 1).cast("int")
    return docs.select("doc_id", citation(F.col("source"), F.col("lang"), first, first + (F.col("doc_id") % 2).cast("int")).alias("cite"))


def _hits(spark, sf):
    found = _index(spark, sf).retrieve(_asked(spark, sf)).select("qid", "place", "doc_id")
    docs = _docs(spark, sf).select(
        "doc_id", F.col("source").alias("name"), F.col("lang").alias("section"), F.lit(1).alias("page_start"),
        (F.col("doc_id") % 2 + 1).cast("int").alias("page_end"), F.col("doc_id").alias("chunk_id"), F.contains("text", F.lit("|")).alias("has_table"), "text",
    )
    # Ranked on narrow rows; texts are fetched for the few hits only.
    return docs.join(F.broadcast(found), "doc_id")


def build_context(spark, sf):
    return answering.build_context(_hits(spark, sf)).select("qid", "n_hits", F.sha1("context").alias("context_sha1"), F.length("context").alias("chars"))


def build_prompt(spark, sf):
    context = answering.build_context(_hits(spark, sf))
    rows = context.join(_questions(spark, sf), "qid")
    prompt = answering.user_prompt(F.col("text"), retrieval.expansion(F.col("text"), SYNONYMS), F.col("n_hits"), F.col("context"))
    return answering.generate(rows.select("qid", prompt.alias("prompt"))).select(
        "qid", F.sha1("prompt").alias("prompt_sha1"), F.sha1("answer").alias("answer_sha1"), answering.refused(F.col("answer")).alias("refused")
    )


def _evaluated(spark, sf):
    asked, stored = _asked(spark, sf), _index(spark, sf)
    out = None
    for name, mode, own in (("vector", "vector", False), ("bm25", "bm25", False), ("hybrid+company", "hybrid", True)):
        hits = stored.retrieve(asked, mode, company_filter=own).join(stored.codes, "doc_id").select("qid", F.lit(name).alias("config"), "place", "code")
        out = hits if out is None else out.unionByName(hits)
    return answering.evaluate_hits(out, asked.select("qid", F.col("code").alias("target")))


def eval_hits(spark, sf):
    return _evaluated(spark, sf)


def eval_summary(spark, sf):
    return answering.summarise(_evaluated(spark, sf))


def known_item_recall(spark, sf):
    """For each question found word for word in some document: is one of these among BM25's best ten?"""
    best = _bm25_best(spark, sf, _questions(spark, sf), 10).select("qid", "doc_id")
    stored = _index(spark, sf)
    truth = lexical.containing(stored.corpus.select("doc_id", "text"), stored.statistics, _questions(spark, sf)).select("qid", "doc_id")
    hit = truth.join(best.withColumn("hit", F.lit(1)), ["qid", "doc_id"], "left")
    return hit.groupBy("qid").agg(F.count(F.lit(1)).alias("truths"), (F.max(F.coalesce("hit", F.lit(0))) == 1).alias("found"))


def gt_scan(spark, sf):
    """Where documents hold a benchmark passage word for word."""
    stored = _index(spark, sf)
    found = lexical.containing(stored.corpus.select("doc_id", "text"), stored.statistics, _questions(spark, sf))
    return found.select(F.col("qid").alias("item_id"), "doc_id", "at")


QUERIES = {
    "tokens_per_doc": tokens_per_doc, "doc_freq": doc_freq, "idf_floor": idf_floor, "bm25_scores": bm25_scores, "bm25_top10": bm25_top10,
    "bm25_batch_topk": bm25_batch_topk, "vector_norms": vector_norms, "vector_topk": vector_topk, "vector_batch_topk": vector_batch_topk,
    "vector_topk_in_pool": vector_topk_in_pool, "rrf_fuse": rrf_fuse, "hybrid_topk": _search("hybrid"), "mode_bm25_only": _search("bm25"),
    "mode_vector_only": _search("vector"), "rrf_k_sweep": rrf_k_sweep, "mode_diff": mode_diff, "detect_entity": detect_entity,
    "expand_query": expand_query, "two_round_retrieve": two_round_retrieve, "company_pool_topk": company_pool_topk,
    "ablation_grid": ablation_grid, "cite_format": cite_format, "build_context": build_context, "build_prompt": build_prompt,
    "eval_hits": eval_hits, "eval_summary": eval_summary, "known_item_recall": known_item_recall, "gt_scan": gt_scan,
}

_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')"


def _bm25_sql(corpus: str, questions: str) -> str:
    """CTEs tok .. score (qid, doc_id, s) over a corpus (doc_id, text) and questions (qid, text)."""
    return f"""tok AS (SELECT doc_id, {_TOKENS} AS ts FROM {corpus}),
size AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM tok) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
raw AS (SELECT t, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, size),
idf AS (SELECT t, df, CASE WHEN r >= 0 THEN r ELSE 0.25 * (SELECT avg(r) FROM raw) END AS idf FROM raw),
qt AS (SELECT qid, t, count(*) AS times FROM (SELECT qid, unnest({_TOKENS}) AS t FROM {questions}) GROUP BY ALL),
score AS (
  SELECT qid, tf.doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avgdl))), 6) AS s
  FROM qt JOIN tf USING (t) JOIN idf USING (t) JOIN tok ON tok.doc_id = tf.doc_id, size GROUP BY qid, tf.doc_id
)"""


_QS = "qs AS (SELECT item_id AS qid, text FROM benchmark)"
_ENTITY = "coalesce(" + ", ".join(f"CASE WHEN contains(text, 'src{k}') THEN 'src{k}' END" for k in range(20)) + ")"
#: Everything that hybrid queries share: corpus, questions, both scores of all pairs, both routes in both rounds.
_HYBRID = f"""
corpus AS (SELECT doc_id, text, source AS code, embedding::DOUBLE[] AS e FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
asked0 AS (
  SELECT item_id AS qid, text || CASE WHEN item_id % 4 != 0 THEN ' src' || (item_id % 20) ELSE '' END AS text, embedding::DOUBLE[] AS e
  FROM benchmark JOIN embeddings ON item_id = vec_id
),
asked AS (SELECT *, {_ENTITY} AS code FROM asked0),
{_bm25_sql("corpus", "asked")},
pairs AS (
  SELECT a.qid, c.doc_id, c.code, a.code AS target, round(list_dot_product(a.e, c.e), 6) AS v, coalesce(s, 0) AS b
  FROM asked a CROSS JOIN corpus c LEFT JOIN score ON score.qid = a.qid AND score.doc_id = c.doc_id
),
both_pools AS (
  SELECT *, 'global' AS round FROM pairs UNION ALL SELECT *, 'company' AS round FROM pairs WHERE code = target
),
ranked AS (
  SELECT *, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY qid, round ORDER BY v DESC NULLS LAST, doc_id) END AS vr,
    row_number() OVER (PARTITION BY qid, round ORDER BY b DESC, doc_id) AS br FROM both_pools
)"""


def _fused(mode: str, depth: int, rounds: str, k: int = 60, name: str = "fused", top: int = 6) -> str:
    """CTE with the fused rows of a mode: vec_rank and bm_rank within the depth, place within the round."""
    vr = f"CASE WHEN vr <= {depth} THEN vr END" if mode != "bm25" else "NULL::BIGINT"
    br = f"CASE WHEN br <= {depth} THEN br END" if mode != "vector" else "NULL::BIGINT"
    tie = "b" if mode == "bm25" else "v"
    return f"""{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, round ORDER BY rrf DESC, {tie} DESC NULLS LAST, vec_rank ASC NULLS LAST, bm_rank ASC NULLS LAST, doc_id) AS place
    FROM (
      SELECT *, round(coalesce(1.0 / ({k} + vec_rank), 0) + coalesce(1.0 / ({k} + bm_rank), 0), 9) AS rrf
      FROM (SELECT qid, doc_id, code, target, round, v, b, {vr} AS vec_rank, {br} AS bm_rank FROM ranked WHERE round IN ({rounds}))
      WHERE vec_rank IS NOT NULL OR bm_rank IS NOT NULL
    )
  ) WHERE place <= {top}
)"""


def _merged(name: str, fused: str) -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round, place) AS final FROM (
      SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round) AS nth,
        string_agg(round, '+') OVER (PARTITION BY qid, doc_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rounds,
        count(*) FILTER (WHERE round = 'company') OVER (PARTITION BY qid) AS nc
      FROM {fused}
    ) WHERE nth = 1
  ) WHERE final <= 6
)"""


_BOTH, _GLOBAL = "'company', 'global'", "'global'"


def _mode_sql(mode: str) -> str:
    depth = 10 if mode == "hybrid" else 6
    return f"WITH {_HYBRID}, {_fused(mode, depth, _GLOBAL)} SELECT qid, place, doc_id, vec_rank, bm_rank, v AS vec_score, b AS bm_score FROM fused"


def _topk_sql(where: str, pool: bool = False) -> str:
    return f"""WITH s AS (
  SELECT a.vec_id AS qid, c.vec_id AS doc_id, round(list_dot_product(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a JOIN embeddings c ON {"a.label = c.label" if pool else "true"} WHERE {where}
), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT qid, doc_id, score, rank FROM r WHERE rank <= 10"""


def _bm25_best_sql(where: str, columns: str) -> str:
    return f"""WITH {_QS}, one AS (SELECT * FROM qs WHERE {where}), {_bm25_sql("documents", "one")},
r AS (
  SELECT q.qid, d.doc_id, coalesce(s, 0) AS score, row_number() OVER (PARTITION BY q.qid ORDER BY coalesce(s, 0) DESC, d.doc_id) AS rank
  FROM one q CROSS JOIN documents d LEFT JOIN score ON score.qid = q.qid AND score.doc_id = d.doc_id
) SELECT {columns} FROM r WHERE rank <= 10"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# A synonym named by two terms ('thing') is lacking from a text that holds neither; no text here needs it twice.
_EXPAND = (
    "array_to_string(list_filter(flatten([" + ", ".join(f"CASE WHEN contains(text, '{t}') THEN {_list(ws)} ELSE [] END" for t, ws in SYNONYMS)
    + "]), lambda w: NOT contains(text, w)), ',')"
)
_HITS_SQL = f"""{_HYBRID}, {_fused("hybrid", 10, _BOTH)}, {_merged("hits", "fused")},
entries AS (
  SELECT qid, final, '[' || final || '] ' || d.source || ' · ' || d.lang || ' · p1' || CASE WHEN d.doc_id % 2 = 1 THEN '-2' ELSE '' END
    || ' (' || d.doc_id || ', ' || CASE WHEN contains(d.text, '|') THEN 'table' ELSE 'body' END || ')' || chr(10) || d.text AS entry, d.text AS body
  FROM hits JOIN documents d USING (doc_id)
),
context AS (SELECT qid, count(*) AS n_hits, string_agg(entry, chr(10) || chr(10) ORDER BY final) AS context, min(body) FILTER (WHERE final = 1) AS top FROM entries GROUP BY qid)"""


def _eval_sql() -> str:
    parts = [("vector", "vector", 6, _GLOBAL), ("bm25", "bm25", 6, _GLOBAL), ("hybrid+company", "hybrid", 10, _BOTH)]
    ctes = ", ".join(f"{_fused(m, d, r, name=f'f{k}')}, {_merged(f'm{k}', f'f{k}')}" for k, (_, m, d, r) in enumerate(parts))
    rows = " UNION ALL ".join(f"SELECT '{n}' AS config, qid, final, code, target FROM m{k}" for k, (n, *_) in enumerate(parts))
    return f"""WITH {_HYBRID}, {ctes}, every AS ({rows}),
evals AS (
  SELECT qid, config, CASE WHEN any_value(target) IS NOT NULL THEN count(*) FILTER (WHERE code = target) END AS n_hit,
    bool_or(code = target) FILTER (WHERE final = 1) AS top1_ok FROM every GROUP BY qid, config
)"""


def _ablation_sql() -> str:
    ctes, rows = [], []
    for mode in retrieval.MODES:
        for own in (True, False):
            n = f"{mode}_{int(own)}"
            ctes.append(f"{_fused(mode, 10 if mode == 'hybrid' else 6, _BOTH if own else _GLOBAL, name='f_' + n)}, {_merged('m_' + n, 'f_' + n)}")
            rows.append(
                f"SELECT '{mode}' AS mode, {own} AS company_filter, qid, count(*) FILTER (WHERE code = target) AS n_hit "
                f"FROM m_{n} WHERE target IS NOT NULL GROUP BY qid"
            )
    return f"WITH {_HYBRID}, {', '.join(ctes)} {' UNION ALL '.join(rows)}"


ORACLES = {
    "tokens_per_doc": f"SELECT doc_id, len({_TOKENS})::BIGINT AS n_tokens FROM documents",
    "doc_freq": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term",
    "idf_floor": f"""WITH df AS (SELECT t, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS t FROM documents) GROUP BY t),
raw AS (SELECT t, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS r FROM df)
SELECT t AS term, df, round(CASE WHEN r >= 0 THEN r ELSE 0.25 * avg(r) OVER () END, 6) AS idf FROM raw""",
    "gt_scan": "SELECT item_id, doc_id, instr(d.text, b.text)::INT AS at FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "bm25_scores": f"""WITH {_QS}, one AS (SELECT * FROM qs WHERE qid = 2), {_bm25_sql("documents", "one")}
SELECT d.doc_id, coalesce(s, 0.0) AS score FROM documents d LEFT JOIN score USING (doc_id)""",
    "bm25_top10": _bm25_best_sql("qid = 2", "doc_id, score, rank"),
    "bm25_batch_topk": _bm25_best_sql("true", "qid, doc_id, score, rank"),
    "vector_norms": """SELECT count(*) AS vectors, round(min(n), 5) AS least, round(max(n), 5) AS most
FROM (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""",
    "vector_topk": f"SELECT doc_id, score, rank FROM ({_topk_sql('a.vec_id = 0')})",
    "vector_batch_topk": _topk_sql("a.vec_id % 20 = 0"),
    "vector_topk_in_pool": _topk_sql("a.vec_id % 20 = 0", True),
    "rrf_fuse": f"WITH {_HYBRID}, {_fused('hybrid', 10, _GLOBAL, top=20)} SELECT qid, place, doc_id, vec_rank, bm_rank, rrf FROM fused",
    "hybrid_topk": _mode_sql("hybrid"), "mode_bm25_only": _mode_sql("bm25"), "mode_vector_only": _mode_sql("vector"),
    "rrf_k_sweep": f"""WITH {_HYBRID}, ks AS (SELECT unnest([1, 3, 5, 10, 20, 60, 200])::INT AS k),
m AS (
  SELECT k, qid, doc_id, v, vr, round(coalesce(CASE WHEN vr <= 10 THEN 1.0 / (k + vr) END, 0) + coalesce(CASE WHEN br <= 10 THEN 1.0 / (k + br) END, 0), 9) AS rrf
  FROM ranked, ks WHERE round = 'global' AND (vr <= 10 OR br <= 10)
),
p AS (SELECT *, row_number() OVER (PARTITION BY k, qid ORDER BY rrf DESC, v DESC NULLS LAST, CASE WHEN vr <= 10 THEN vr END ASC NULLS LAST, doc_id) AS place FROM m)
SELECT k, qid, place, doc_id, rrf FROM p WHERE place <= 6""",
    "mode_diff": f"""WITH {_HYBRID} SELECT qid, doc_id, CASE WHEN vr <= 6 THEN 'vector' ELSE 'bm25' END AS only
FROM ranked WHERE round = 'global' AND coalesce(vr <= 6, false) != (br <= 6)""",
    "detect_entity": f"WITH {_HYBRID} SELECT qid, code, 'Source ' || substr(code, 4) AS name FROM asked",
    "expand_query": f"""WITH x AS (SELECT item_id AS qid, text, {_EXPAND} AS added FROM benchmark)
SELECT qid, added, CASE WHEN added = '' THEN text ELSE text || '（' || replace(added, ',', '、') || '）' END AS expanded FROM x""",
    "two_round_retrieve": f"""WITH {_HYBRID}, {_fused("hybrid", 10, _BOTH)}, {_merged("hits", "fused")}
SELECT qid, final AS place, doc_id, rounds, round AS source, vec_rank, bm_rank, CASE WHEN nc > 0 THEN nc END AS n_returned FROM hits""",
    "company_pool_topk": f"""WITH {_HYBRID}, {_fused("hybrid", 10, "'company'")} SELECT qid, place, doc_id, vec_rank, bm_rank FROM fused""",
    "ablation_grid": _ablation_sql(),
    "cite_format": """SELECT doc_id, source || ' · ' || lang || ' · p' || (doc_id % 7 + 1)
  || CASE WHEN doc_id % 2 = 1 THEN '-' || (doc_id % 7 + 2) ELSE '' END AS cite FROM documents""",
    "build_context": f"WITH {_HITS_SQL} SELECT qid, n_hits, sha1(context) AS context_sha1, length(context)::INT AS chars FROM context",
    "build_prompt": f"""WITH {_HITS_SQL},
q AS (SELECT item_id AS qid, text, {_EXPAND} AS added FROM benchmark),
p AS (
  SELECT qid, '[Question] ' || text || chr(10) || chr(10) || CASE WHEN added != '' THEN '[Terms] also searched: ' || replace(added, ',', ', ') || chr(10) || chr(10) ELSE '' END
    || '[Context] ' || n_hits || ' passages' || chr(10) || chr(10) || context AS prompt,
    coalesce(list_filter(string_split(context, chr(10)), lambda x: x != '' AND NOT starts_with(x, '['))[1], '{C.REFUSAL}') AS answer
  FROM context JOIN q USING (qid)
)
SELECT qid, sha1(prompt) AS prompt_sha1, sha1(answer) AS answer_sha1, contains(answer, '{C.REFUSAL}') AS refused FROM p""",
    "eval_hits": _eval_sql() + " SELECT * FROM evals",
    "eval_summary": _eval_sql() + """ SELECT config, round(avg(n_hit), 6) AS mean_hits, round(avg(top1_ok::INT), 6) AS first_rate,
count(*) AS questions FROM evals WHERE n_hit IS NOT NULL GROUP BY config""",
    "known_item_recall": f"""WITH {_QS}, one AS (SELECT * FROM qs), {_bm25_sql("documents", "one")},
r AS (
  SELECT q.qid, d.doc_id, row_number() OVER (PARTITION BY q.qid ORDER BY coalesce(s, 0) DESC, d.doc_id) AS rank
  FROM one q CROSS JOIN documents d LEFT JOIN score ON score.qid = q.qid AND score.doc_id = d.doc_id
)
SELECT q.qid, count(*) AS truths, bool_or(rank <= 10) AS found FROM qs q JOIN documents d ON contains(d.text, q.text)
JOIN r ON r.qid = q.qid AND r.doc_id = d.doc_id GROUP BY q.qid""",
}
