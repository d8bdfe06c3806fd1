"""Entity detection, query expansion, rank fusion and two-round hybrid retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import constants as C
from quillstone.operators import dense, lexical
from quillstone.sources.shared import shared_dir

MODES = ("vector", "bm25", "hybrid")


def detect_entity(text: Column, entities: list[tuple[str, str, list[str]]] = C.ENTITIES) -> Column:
    """struct(code, name) of the one entity a text names, or null.

    The first code, in catalog order, that occurs anywhere wins; else the longest alias, of equally
    long ones that of the larger (code, name).
    """
    by_code = F.coalesce(*(F.when(F.contains(text, F.lit(c)), F.struct(F.lit(c).alias("code"), F.lit(n).alias("name"))) for c, n, _ in entities))
    aliases = sorted(((len(a), c, n, a) for c, n, own in entities for a in own), reverse=True)
    by_alias = F.coalesce(
        *(F.when(F.contains(text, F.lit(a)), F.struct(F.lit(c).alias("code"), F.lit(n).alias("name"))) for _, c, n, a in aliases)
    )
    return F.coalesce(by_code, by_alias)


def expansion(text: Column, synonyms: list[tuple[str, list[str]]] = C.SYNONYMS) -> Column:
    """Synonyms of the terms that occur, in table order, that the text lacks; each once."""
    none = F.array().cast("array<string>")
    found = [
        F.when(F.contains(text, F.lit(term)), F.filter(F.array(*map(F.lit, words)), lambda w: ~F.contains(text, w))).otherwise(none)
        for term, words in synonyms
    ]
    return F.array_distinct(F.concat(*found)) if found else none


def expanded(text: Column, added: Column) -> Column:
    return F.when(F.size(added) > 0, F.concat(text, F.lit("（"), F.array_join(added, "、"), F.lit("）"))).otherwise(text)


def fuse(routes: DataFrame, by: list[str], k: int, rrf_k: int = C.RRF_K, tie: str = "vec_score") -> DataFrame:
    """Reciprocal rank fusion of (*by, doc_id, route, rank, vec_score, bm_score).

    One row per document: its ranks, rrf, scores and place. Ties in rrf go to the higher ``tie``
    score, then to the vector route's order, then to the other's.
    """
    merged = routes.groupBy(*by, "doc_id").agg(
        F.max(F.when(F.col("route") == "vector", F.col("rank"))).alias("vec_rank"),
        F.max(F.when(F.col("route") == "bm25", F.col("rank"))).alias("bm_rank"),
        F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("rrf"),
        F.max("vec_score").alias("vec_score"),
        F.max("bm_score").alias("bm_score"),
    )
    order = Window.partitionBy(*by).orderBy(
        F.desc("rrf"), F.desc(tie), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("bm_rank"), "doc_id"
    )
    return merged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def stored(rows: DataFrame) -> DataFrame:
    """The rows, written in the shared folder."""
    folder = f"{shared_dir(rows.sparkSession)}/candidates-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


class HybridIndex:
    """Documents (doc_id, text, code, embedding) and everything asked of them.

    A document without a vector is in the lexical route only. ``statistics`` may come from a stored index.
    """

    def __init__(self, corpus: DataFrame, statistics: lexical.Statistics | None = None):
        self.corpus = corpus
        self.vectors = corpus.where("embedding is not null").select("doc_id", "code", "embedding")
        self.statistics = statistics or lexical.statistics(lexical.tokenised(corpus))
        self.codes = corpus.select("doc_id", "code")

    def scores(self, questions: DataFrame) -> DataFrame:
        """BM25 of (qid, text), with each document's code."""
        return lexical.bm25(self.statistics, questions.select("qid", "text")).join(self.codes, "doc_id")

    def routes(self, questions: DataFrame, mode: str, top: int, rounds: tuple[str, ...] = ("global",)) -> DataFrame:
        """(qid, round, route, doc_id, rank, vec_score, bm_score) of candidates.

        ``questions`` is (qid, text, embedding[, code]). A company round ranks the documents of the
        question's code only; statistics stay global. Both scores are given whatever the mode.
        """
        depth = C.ROUTE_DEPTH if mode == "hybrid" else top
        n = questions.count()
        scored = lexical.bm25(self.statistics, questions.select("qid", "text")) if mode != "vector" else None
        found = []
        for name in rounds:
            asked = questions if name == "global" else questions.where("code is not null")
            if mode in ("vector", "hybrid"):
                near = dense.vector_topk(self.vectors, asked, depth, None if name == "global" else "code")
                found.append(near.select("qid", F.lit(name).alias("round"), F.lit("vector").alias("route"), "doc_id", "rank"))
            if mode in ("bm25", "hybrid"):
                if name == "global":
                    first = self.codes.select("doc_id").orderBy("doc_id").limit(2 * depth)
                    padding, inside = asked.select("qid").join(F.broadcast(first)), scored
                else:
                    first = lexical.pads(self.codes, depth, "code")
                    padding = asked.select("qid", "code").join(first, "code").select("qid", "doc_id")
                    inside = scored.join(self.codes, "doc_id").join(lexical.small(asked.select("qid", "code"), n), ["qid", "code"])
                ranked = lexical.padded_best(inside, padding, depth, "qid")
                found.append(ranked.select("qid", F.lit(name).alias("round"), F.lit("bm25").alias("route"), "doc_id", "rank"))
        routes = found[0]
        for part in found[1:]:
            routes = routes.unionByName(part)
        # The few candidates are written, so that what follows does not rank all documents again.
        routes = stored(routes)
        pairs = routes.select("qid", "doc_id").distinct()
        few = 2 * n * depth * len(rounds)
        near = (
            self.vectors.select("doc_id", "embedding").join(lexical.small(pairs, few), "doc_id")
            .join(questions.select("qid", F.col("embedding").alias("asked")), "qid")
            .select("qid", "doc_id", F.round(dense.dot("embedding", "asked"), lexical.DIGITS).alias("vec_score"))
        )
        own = self.statistics
        postings = own.postings.join(lexical.small(pairs.select("doc_id").distinct(), few), "doc_id", "left_semi")
        lexic = lexical.bm25(lexical.Statistics(postings, own.terms, own.size), questions.select("qid", "text")).select("qid", "doc_id", F.col("score").alias("bm_score"))
        lexic = lexic.join(lexical.small(pairs, few), ["qid", "doc_id"], "left_semi")
        return routes.join(near, ["qid", "doc_id"], "left").join(lexic, ["qid", "doc_id"], "left").fillna(0.0, ["bm_score"])

    def search(self, questions: DataFrame, mode: str = "hybrid", top: int = C.TOP, rrf_k: int = C.RRF_K) -> DataFrame:
        """One global round: (qid, place, doc_id, vec_rank, bm_rank, rrf, vec_score, bm_score)."""
        tie = "bm_score" if mode == "bm25" else "vec_score"
        return fuse(self.routes(questions, mode, top), ["qid"], top, rrf_k, tie)

    def retrieve(
        self, questions: DataFrame, mode: str = "hybrid", top: int = C.TOP, company_filter: bool = True, routes: DataFrame | None = None
    ) -> DataFrame:
        """A round within the question's entity, if it names one, then a global round for the rest.

        Adds ``rounds`` (both tags where both found the document), ``source`` (the first) and
        ``n_returned`` (rows of the company round) to what ``search`` gives. ``routes`` may be those of both
        rounds in hybrid mode, whose first ranks are those of every mode.
        """
        rounds = ("company", "global") if company_filter else ("global",)
        tie = "bm_score" if mode == "bm25" else "vec_score"
        if routes is None:
            routes = self.routes(questions, mode, top, rounds)
        else:
            routes = routes.where(F.col("round").isin(*rounds))
            routes = routes if mode == "hybrid" else routes.where((F.col("route") == mode) & (F.col("rank") <= top))
        fused = fuse(routes, ["qid", "round"], top, C.RRF_K, tie)
        merged = fused.groupBy("qid", "doc_id").agg(
            F.min_by(F.struct("round", "place", "vec_rank", "bm_rank", "rrf", "vec_score", "bm_score"), "round").alias("h"),
            F.array_join(F.sort_array(F.collect_list("round")), "+").alias("rounds"),
        )
        counts = fused.where("round = 'company'").groupBy("qid").agg(F.count(F.lit(1)).alias("n_returned"))
        order = Window.partitionBy("qid").orderBy("h.round", "h.place")
        out = merged.withColumn("final", F.row_number().over(order)).where(F.col("final") <= top).join(counts, "qid", "left")
        return out.select(
            "qid", F.col("final").alias("place"), "doc_id", "h.vec_rank", "h.bm_rank", "h.rrf", "h.vec_score", "h.bm_score",
            "rounds", F.col("h.round").alias("source"), "n_returned",
        )
