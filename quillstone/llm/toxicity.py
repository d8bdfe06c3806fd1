"""Toxicity by two class-conditional Kneser-Ney models.

Words are read as character sequences between word marks. Each class has an interpolated
Kneser-Ney model of them: full counts at the highest order, continuation counts below, one
absolute discount per order. The models share their backoff distribution (continuation counts of
both classes together), so that expressions rare in one class are smoothed by what both have seen
and differ only where a class gives evidence. A text is judged by the length-normalised
difference of both log-likelihoods and by that of its most toxic words; a logistic fit to the
training rows turns these into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import textblocks as tb
from quillstone.llm.scratch import bounded_batches

U64 = np.uint64
ORDER = 5
MARK = 32


def letters(found: tb.Words) -> tuple[np.ndarray, np.ndarray]:
    """All words' bytes, each with a mark before and after; the word of each byte."""
    size = found.end - found.start
    word = np.repeat(np.arange(len(size)), size + 2)
    at = np.arange(len(word)) - np.repeat(np.cumsum(size + 2) - size - 2, size + 2)
    inner = (at > 0) & (at <= np.repeat(size, size + 2))
    out = np.full(len(word), MARK, np.uint8)
    out[inner] = found.data[(np.repeat(found.start, size + 2) + at - 1)[inner]]
    return out, word


def keys(data: np.ndarray, word: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams within words that end at each position, as numbers, and where they end."""
    if len(data) < order:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    value = np.zeros(len(data) - order + 1, U64)
    for k in range(order):
        value = (value << U64(8)) | data[k : len(data) - order + 1 + k].astype(U64)
    good = np.flatnonzero(word[order - 1 :] == word[: len(word) - order + 1])
    return value[good], good + order - 1


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = np.asarray(batch.column("toxic"))
        for at, to, found in tb.blocks(batch.column("text"), tb.BLANK_WORDS, fold=True, limit=1 << 18):
            data, word = letters(found)
            label = np.repeat(toxic[at:to], found.counts())[word] if len(word) else toxic[:0]
            value, end = keys(data, word, ORDER)
            # Shorter contexts at a word's beginning are counted with zero bytes before them.
            for short in range(2, ORDER):
                v, e = keys(data, word, short)
                begin = (e == short - 1) | (word[np.maximum(e - short, 0)] != word[e])
                value, end = np.append(value, v[begin]), np.append(end, e[begin])
            for c in (0, 1):
                v, n = np.unique(value[label[end] == c], return_counts=True)
                yield pa.record_batch([pa.array(v.astype(np.int64)), pa.array(np.full(len(v), c)), pa.array(n)], names=["gram", "toxic", "n"])


def _lookup(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = np.searchsorted(known, values)
    place[place == len(known)] = 0
    return np.where(known[place] == values, place, -1) if len(known) else np.full(len(values), -1)


class Level:
    """One order of a model: discounted counts, and the mass left to the order below for each context."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.gram, at = np.unique(gram, return_inverse=True)
        self.n = np.bincount(at, weights=n, minlength=len(self.gram))
        ones, twos = np.count_nonzero(self.n == 1), np.count_nonzero(self.n == 2)
        self.discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        self.context, at = np.unique(self.gram >> U64(8), return_inverse=True)
        self.total = np.bincount(at, weights=self.n, minlength=len(self.context))
        self.kinds = np.bincount(at, minlength=len(self.context)).astype(float)

    def estimate(self, gram: np.ndarray, below: np.ndarray) -> np.ndarray:
        if not len(self.gram):
            return below
        c = _lookup(self.context, gram >> U64(8))
        g = _lookup(self.gram, gram)
        total = np.where(c >= 0, self.total[c], 1.0)
        own = np.where(g >= 0, np.maximum(self.n[g] - self.discount, 0), 0.0) / total
        rest = np.where(c >= 0, self.discount * self.kinds[c] / total, 1.0)
        return own + rest * below


def _cut(gram: np.ndarray, order: int) -> np.ndarray:
    return gram & U64((1 << 8 * order) - 1)


@dataclass
class ToxicityModel:
    classes: list[Level]
    shared: list[Level]
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    @classmethod
    def build(cls, gram: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> ToxicityModel:
        tops = [Level(gram[toxic == c], n[toxic == c]) for c in (0, 1)]
        shared, now = [], np.unique(gram)
        for order in range(ORDER - 1, 0, -1):
            # Continuation counts: in how many distinct longer n-grams does the shorter one end?
            shared.append(Level(_cut(now, order), np.ones(len(now))))
            now = np.unique(_cut(now, order))
        return cls(tops, shared, np.zeros(4), np.zeros(3), np.ones(3))

    def ratios(self, gram: np.ndarray) -> np.ndarray:
        """log P(byte | context, toxic) - log P(byte | context, ordinary) of each n-gram."""
        gram, at = np.unique(gram, return_inverse=True)
        below = np.full(len(gram), 1 / 256)
        for k in range(len(self.shared) - 1, -1, -1):
            below = self.shared[k].estimate(_cut(gram, ORDER - 1 - k), below)
        # A class that has not seen a context says nothing: it falls to what both share.
        return np.log(self.classes[1].estimate(gram, below) / self.classes[0].estimate(gram, below))[at]

    def features(self, found: tb.Words) -> np.ndarray:
        """(documents, 3): difference per word, mean of the three most toxic words, share of toxic words."""
        data, word = letters(found)
        value, end = keys(data, word, ORDER)
        for short in range(2, ORDER):
            v, e = keys(data, word, short)
            begin = (e == short - 1) | (word[np.maximum(e - short, 0)] != word[e])
            value, end = np.append(value, v[begin]), np.append(end, e[begin])
        each = np.bincount(word[end], weights=self.ratios(value), minlength=len(found.hash)) if len(end) else np.zeros(len(found.hash))
        n = found.counts()
        out = np.zeros((len(n), 3))
        total = np.concatenate(([0], np.cumsum(each)))
        out[:, 0] = (total[found.first[1:]] - total[found.first[:-1]]) / np.maximum(n, 1)
        above = np.concatenate(([0], np.cumsum(each > WORD_RATIO)))
        out[:, 2] = np.log1p(above[found.first[1:]] - above[found.first[:-1]]) - 0.5 * np.log1p(n / 50)
        for d in np.flatnonzero(n):
            own = each[found.first[d] : found.first[d + 1]]
            out[d, 1] = np.partition(own, -3)[-3:].mean() if len(own) > 3 else own.sum() / 3
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.centre) / self.scale
        return 1 / (1 + np.exp(-(z @ self.weights[:-1] + self.weights[-1])))

    def fit(self, features: np.ndarray, toxic: np.ndarray) -> None:
        """Ridge-penalised logistic regression by Newton steps."""
        self.centre, self.scale = features.mean(axis=0), features.std(axis=0) + 1e-9
        x = np.column_stack(((features - self.centre) / self.scale, np.ones(len(features))))
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (p - toxic) + 1e-2 * w)
            w -= step
        self.weights = w


#: A word counts as toxic from this log ratio on.
WORD_RATIO = 3.0
FEATURES = "f0 double, f1 double, f2 double"


def _scorer(model: ToxicityModel, raw: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.features(w) for _, _, w in tb.blocks(batch.column("text"), tb.BLANK_WORDS, fold=True, limit=1 << 18)]
            found = np.concatenate(parts) if parts else np.zeros((0, 3))
            columns = {"id": batch.column("id")}
            columns |= {f"f{k}": pa.array(found[:, k]) for k in range(3)} if raw else {"score": pa.array(model.score(found))}
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    model_rows: int = 4000, fit_rows: int = 1000,
) -> ToxicityModel:
    """Both class models and the logistic fit, from disjoint samples of labelled rows.

    About ``model_rows`` rows of each class teach the language models and ``fit_rows`` the score;
    they are drawn by a hash of their id, so a larger table changes which rows, not how many. Rows
    without an id, text or 0/1 label teach nothing; several labels of one id count separately. The
    driver receives n-gram counts and three numbers a row of these samples.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")
    )
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = F.when(F.col("toxic") == 1, sizes.get(1, 0)).otherwise(sizes.get(0, 0))
    draw = F.pmod(F.xxhash64(F.lit("toxicity sample"), "id"), F.lit(1 << 30)) * size / (1 << 30)
    # A class with fewer rows than asked for is split in proportion.
    both = F.lit(model_rows + fit_rows)
    place = F.when(size > both, draw).otherwise(draw * both / F.greatest(size, F.lit(1)))
    drawn = marked.withColumn("place", place).where(F.col("place") < both)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # The sample is bounded by the two parameters, whatever the size of the tables.
    sample = texts.join(F.broadcast(drawn), "id").select("id", "text", "toxic", "place")
    counts = (
        sample.where(F.col("place") < model_rows).select("text", "toxic")
        .mapInArrow(_counter, "gram long, toxic long, n long")
        .groupBy("gram", "toxic").agg(F.sum("n").alias("n")).toArrow()
    )
    model = ToxicityModel.build(
        counts.column("gram").to_numpy().view(U64), counts.column("toxic").to_numpy(), counts.column("n").to_numpy().astype(float)
    )
    rest = sample.where(F.col("place") >= model_rows).select(F.col("toxic").alias("id"), "text")
    found = rest.mapInArrow(_scorer(model, raw=True), f"id int, {FEATURES}").toArrow()
    if found.num_rows:
        model.fit(np.column_stack([found.column(f"f{k}").to_numpy() for k in range(3)]), found.column("id").to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted) of each row; only the text is looked at.

    A text that is null or without words has no evidence and gets what the fit gives to zeros. With
    nothing learnt, every score is 0.5. Repeated rows get equal results, ids may be null, very long
    texts are read whole, other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    out = texts.mapInArrow(_scorer(model, raw=False), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
