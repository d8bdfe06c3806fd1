"""Cosine scores of unit vectors: exact top-k by blocked matrix products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.lexical import DIGITS, best

#: Query vectors that are sent to the executors at a time.
QUERY_BLOCK = 4096


def norm(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: str, b: str) -> Column:
    """Inner product, summed as doubles."""
    parts = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _local_best(qid: np.ndarray, pool: list, queries: np.ndarray, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column("doc_id"))
            score = np.round(queries @ _matrix(batch.column("embedding"), queries.shape[1]).T, DIGITS)
            own = np.array(batch.column("pool").to_pylist(), object)
            places = {name: np.flatnonzero(own == name) for name in set(pool) & set(own.tolist()) - {None}}
            none, rows = np.zeros(0, np.int64), []
            for q, name in enumerate(pool):
                at = np.arange(len(ids)) if name is None else places.get(name, none)
                if len(at) > 4 * k:  # all that score as the k-th best does, or better
                    least = np.partition(score[q, at], len(at) - k)[len(at) - k]
                    at = at[score[q, at] >= least]
                at = at[np.lexsort((ids[at], -score[q, at]))[:k]]
                rows.append((np.full(len(at), qid[q]), ids[at], score[q, at]))
            q, d, s = (np.concatenate(x) for x in zip(*rows))
            yield pa.record_batch([pa.array(q), pa.array(d), pa.array(s)], names=["qid", "doc_id", "score"])

    return run


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, pool: str | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): the k nearest vectors of each query.

    ``vectors`` is (doc_id, embedding), ``queries`` (qid, embedding). With ``pool``, a column of both,
    only vectors of the query's pool count. Queries go to the executors in blocks; each batch of
    vectors is scored by one matrix product and keeps its own best k, which then meet.
    """
    name = F.col(pool).cast("string") if pool else F.lit(None).cast("string")
    rows = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), "embedding", name.alias("pool"))
    asked = queries.select(F.col("qid").cast("long").alias("qid"), "embedding", name.alias("pool")).toArrow().combine_chunks()
    out = None
    for at in range(0, max(asked.num_rows, 1), QUERY_BLOCK):
        block = asked.slice(at, QUERY_BLOCK)
        if not block.num_rows:
            return best(rows.select(F.lit(0).cast("long").alias("qid"), "doc_id", F.lit(0.0).alias("score")).limit(0), k, "qid")
        matrix = np.array(block.column("embedding").to_pylist(), np.float64)
        part = rows.mapInArrow(
            _local_best(np.asarray(block.column("qid")), block.column("pool").to_pylist(), matrix, k), "qid long, doc_id long, score double"
        )
        out = part if out is None else out.unionByName(part)
    return best(out, k, "qid")
