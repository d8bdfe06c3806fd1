"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates.

Each document's set of distinct word shingles is hashed once; the hash space is cut into bins
and the least value of every bin kept (one-permutation hashing). Empty bins borrow from
occupied ones along a fixed random order of their own (optimal densification). Bands of bins
give bucket keys. Documents with equal sets are one class; the classes of a bucket are linked by stars,
confirmed on the full sets (see ``stars``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import textblocks as tb
from quillstone.llm.components import components
from quillstone.llm.scratch import Scratch, quoted
from quillstone.llm.stars import confirmed_links, paired, pick

U64 = np.uint64


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, an empty one none."""
    for _, _, found in tb.blocks(texts, tb.BLANK_WORDS, fold=True):
        whole = tb.sequences(found.hash, words)
        for at, to in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
            if to - at >= words:
                own = np.sort(whole[at : to - words + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            else:
                yield tb.sequences(found.hash[at:to], to - at) if to > at else found.hash[:0]


def borrow_order(bins: int) -> np.ndarray:
    """Row j: the place of each bin in the order in which bin j looks for a value."""
    keys = tb.stream(21, bins * bins).reshape(bins, bins)
    return keys.argsort(axis=1).argsort(axis=1).astype(np.int32)


def signature(own: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """The bins' least values of a sorted, non-empty set, without empty bins."""
    at = ((own >> U64(32)) * U64(bins)) >> U64(32)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    filled = at[first].astype(np.int64)
    out = np.zeros(bins, U64)
    out[filled] = own[first]
    if len(filled) < bins:
        empty = np.ones(bins, bool)
        empty[filled] = False
        empty = np.flatnonzero(empty)
        out[empty] = out[filled[order[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


def _sketcher(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = borrow_order(bands * rows)
        weights = tb.stream(23, rows) | U64(1)
        salt = tb.stream(25, bands)
        for batch in batches:
            n, high, low, keys = [], [], [], []
            for own in shingle_sets(batch.column(1), words):
                n.append(len(own))
                high.append(np.bitwise_xor.reduce(tb.mix(own + U64(1))) if len(own) else U64(0))
                low.append(np.add.reduce(tb.mix(own ^ U64(0x5851F42D4C957F2D))) if len(own) else U64(0))
                if len(own):
                    parts = signature(own, bands * rows, order).reshape(bands, rows)
                    keys.append(tb.mix((parts * weights).sum(axis=1, dtype=U64) ^ salt).view(np.int64))
                else:
                    keys.append(None)
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(high, U64).view(np.int64)),
                    pa.array(np.array(low, U64).view(np.int64)),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["id", "n", "high", "low", "bands"],
            )

    return run


def _setter(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [own.tobytes() for own in shingle_sets(batch.column(1), words)]
            n = pa.array([len(own) // 8 for own in sets], pa.int64())
            yield pa.record_batch([batch.column(0), n, pa.array(sets, pa.binary())], names=["rep", "n", "own"])

    return run


def _sharer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, shared) from the sorted sets x and y of both sides of a pair."""
    for batch in batches:
        shared = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            both = np.concatenate((np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)))
            both.sort(kind="stable")
            shared.append(int(np.count_nonzero(both[1:] == both[:-1])))
        yield pa.record_batch(
            [*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(shared, pa.int64())], names=["a", "b", "na", "nb", "shared"]
        )


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as arrays of longs."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("own")]
        yield pa.record_batch([batch.column("rep"), batch.column("comp"), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "comp", "own"])


class _Sets:
    """The full sets of classes that share a bucket with others."""

    def __init__(self, texts: DataFrame, words: int, percent: int, scratch: Scratch):
        self.texts, self.words, self.percent, self.scratch = texts, words, percent, scratch

    def ready(self, reps: DataFrame) -> DataFrame:
        ids = self.scratch.save(reps.select(F.col("rep").alias("id")), "ids")
        picked = pick(self.texts, ids, ids.count()).dropDuplicates(["id"])
        self.own = self.scratch.save(picked.mapInArrow(_setter(self.words), "rep long, n long, own binary"), "sets")
        return self.own

    def shared(self, pairs: DataFrame) -> DataFrame:
        met = paired(pairs, self.own, self.percent, self.scratch)
        return met.mapInArrow(_sharer, "a long, b long, na long, nb long, shared long")

    def elements(self, reps: DataFrame) -> DataFrame:
        own = self.own.join(reps.select("rep", "comp"), "rep").select("rep", "comp", "own")
        return own.mapInArrow(_elements, "rep long, comp long, own array<long>")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    bands: int = 42,
    rows: int = 6,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; the set of a text is its distinct
    ``words``-word shingles, or its whole word sequence if it has fewer. Two documents are linked
    if their sets' Jaccard similarity is ``similarity`` (in whole percents) at least. With 42 bands
    of 6 bins a pair at 0.8 is missed by all buckets with a probability of 3e-6, a closer one less.

    Texts that are null or have no words have empty sets and are linked with nothing. Repeated
    rows get the same component, and so do different texts under one id, whose links are looked
    for from one of the texts. A row with a null id stands alone:
    its component is null and it is kept. Very long texts are read whole, in one task. Further columns
    of ``docs`` are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    percent = round(100 * similarity)
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    sketch = scratch.save(
        texts.mapInArrow(
            _sketcher(words, bands, rows), "id long, n long, high long, low long, bands array<long>"
        ),
        "sketch",
    )
    known = sketch.where("n > 0 and id is not null")
    classes = scratch.save(
        known.groupBy("high", "low", "n")
        .agg(F.min("id").alias("rep"), F.first("bands").alias("bands")),
        "classes",
    )
    sets = _Sets(texts, words, percent, scratch)
    links = confirmed_links(classes, sets.ready, sets.shared, sets.elements, percent, scratch)
    # A class ties the ids of its copies together, and so an id of several texts its classes.
    copies = known.join(classes.select("high", "low", "n", "rep"), ["high", "low", "n"]).where("id != rep")
    every = components(
        links.unionByName(copies.select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()),
        scratch,
    )
    scratch.sweep(sketch, every)
    out = sketch.join(every, sketch["id"] == every["node"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )

