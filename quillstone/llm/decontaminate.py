"""Benchmark decontamination by a prefix-filtered join of word windows with documents.

A window is contained in a document only if its rarest word is: with full containment asked
for, that one word is the window's necessary prefix. Words are ordered by the number of
documents that hold them (ties by hash). Each occurrence of a prefix word proposes a window at
one place; the positional bound (the window starts in the document) and the length bound (it
ends there) discard places, and the rest are verified word by word.

Windows are the query set. They are dealt into blocks of at most ``block_windows``, whose index
goes to the executors; with more, documents pass block after block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import textblocks as tb
from quillstone.llm.scratch import Scratch, quoted

U64 = np.uint64
BITS = 20
STAGED = 4
#: Distinct words of all windows that are counted together.
MOST_WORDS = 2_000_000


def member(sorted_values: np.ndarray, bitmap: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``values`` that occur in ``sorted_values``, and their places there."""
    at = np.flatnonzero(bitmap[(values >> U64(64 - BITS)).astype(np.int64)])
    if not len(at) or not len(sorted_values):
        return at[:0], at[:0]
    place = np.searchsorted(sorted_values, values[at])
    place[place == len(sorted_values)] = 0
    good = sorted_values[place] == values[at]
    return at[good], place[good]


def bitmap_of(values: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BITS, bool)
    out[(values >> U64(64 - BITS)).astype(np.int64)] = True
    return out


@dataclass
class Index:
    """Distinct windows of one block, by the word that they are looked up by."""

    words: list[np.ndarray]
    items: list[list[str]]
    prefix: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    window: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def order(self, frequency: dict[int, int]) -> None:
        """Index every window by its rarest word."""
        rare, shift = [], []
        for words in self.words:
            keys = [(frequency.get(int(w), 0), int(w), k) for k, w in enumerate(words)]
            _, w, k = min(keys)
            rare.append(w)
            shift.append(k)
        rare = np.array(rare, U64)
        by = np.argsort(rare, kind="stable")
        self.prefix, first = np.unique(rare[by], return_index=True)
        self.first = np.append(first, len(by)).astype(np.int64)
        self.window = by.astype(np.int64)
        self.shift = np.array(shift, np.int64)[by]
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.length = lengths
        self.padded = np.zeros((len(self.words), int(lengths.max(initial=1))), U64)
        for k, words in enumerate(self.words):
            self.padded[k, : len(words)] = words
        self.bitmap = bitmap_of(self.prefix)

    def hits(self, found: tb.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of each occurrence of a window in a block of documents."""
        at, place = member(self.prefix, self.bitmap, found.hash)
        many = self.first[place + 1] - self.first[place]
        entry = np.repeat(self.first[place], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start, window = np.repeat(at, many) - self.shift[entry], self.window[entry]
        doc = np.searchsorted(found.first, np.repeat(at, many), side="right") - 1
        fits = (start >= found.first[doc]) & (start + self.length[window] <= found.first[doc + 1])
        start, window = start[fits], window[fits]
        for k in range(self.padded.shape[1]):
            here = self.length[window] > k
            same = ~here
            same[here] = found.hash[start[here] + k] == self.padded[window[here], k]
            start, window = start[same], window[same]
        return start, window


def windows_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words = [], []
        names = batch.column(0).to_pylist()
        for at, _, found in tb.blocks(batch.column(1), tb.ALNUM_WORDS, fold=True):
            signed = found.hash.view(np.int64)
            for k, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist())):
                for s in range(a, max(a + 1, b - width + 1)) if b > a else ():
                    ids.append(names[at + k])
                    words.append(signed[s : min(s + width, b)])
        yield pa.record_batch([pa.array(ids, pa.string()), pa.array(words, pa.list_(pa.int64()))], names=["item", "words"])


def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """Documents that hold each word of a vocabulary, over all documents."""
    bits = bitmap_of(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, found in tb.blocks(batch.column(0), tb.ALNUM_WORDS, fold=True):
                at, place = member(vocabulary, bits, found.hash)
                doc = np.searchsorted(found.first, at, side="right") - 1
                pairs = np.unique(doc * len(vocabulary) + place)
                total += np.bincount(pairs % max(len(vocabulary), 1), minlength=len(vocabulary))
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["word", "docs"])

    counted = docs.mapInArrow(run, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    return {int(vocabulary[r["word"]]): r["docs"] for r in counted.collect()}


def _find(texts: pa.Array, before: list[dict] | None, index: Index, final: bool) -> pa.Array:
    """(n_words, n_hit, items) of each text, or, where more blocks follow, its hit (spans, items) so far."""
    n_words, n_hit, spans, items = [], [], [], []
    for at, to, found in tb.blocks(texts, tb.ALNUM_WORDS, fold=True):
        start, window = index.hits(found)
        end = start + index.length[window] if len(window) else start
        of: dict[int, set[str]] = {}
        doc = np.searchsorted(found.first, start, side="right") - 1
        for d, w in set(zip(doc.tolist(), window.tolist())):
            of.setdefault(d, set()).update(index.items[w])
        if before is not None:
            for d in range(at, to):
                for s, e in before[d]["spans"]:
                    start, end = np.append(start, s + found.first[d - at]), np.append(end, e + found.first[d - at])
                if before[d]["items"]:
                    of.setdefault(d - at, set()).update(before[d]["items"])
        change = np.bincount(start, minlength=len(found.hash) + 1) - np.bincount(end, minlength=len(found.hash) + 1)
        covered = np.cumsum(change[: len(found.hash)]) > 0
        total = np.concatenate(([0], np.cumsum(covered)))
        n_words += found.counts().tolist()
        n_hit += (total[found.first[1:]] - total[found.first[:-1]]).tolist()
        items += [sorted(of[d]) if d in of else [] for d in range(to - at)]
        if not final:
            edge = np.diff(covered.astype(np.int8), prepend=0, append=0)
            begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            own: list[list[tuple[int, int]]] = [[] for _ in range(to - at)]
            for s, e in zip(begin.tolist(), stop.tolist()):
                # A covered run may cross into the next document; cut it there.
                d = int(np.searchsorted(found.first, s, side="right")) - 1
                while s < e:
                    cut = min(e, int(found.first[d + 1]))
                    if cut > s:
                        own[d].append((s - int(found.first[d]), cut - int(found.first[d])))
                    s, d = max(s, cut), d + 1
            spans += own
    if final:
        columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
        return pa.StructArray.from_arrays(columns, names=["n_words", "n_hit", "items"])
    columns = [pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
    return pa.StructArray.from_arrays(columns, names=["spans", "items"])


def _finder(index: Index, began: bool, final: bool):
    """A function of the text, and of what earlier blocks of windows found in it."""
    kind = "n_words long, n_hit long, items array<string>" if final else "spans array<array<bigint>>, items array<string>"
    if began:

        @F.arrow_udf(kind)
        def more(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, before in batches:
                yield _find(texts, before.to_pylist(), index, final)

        return more

    @F.arrow_udf(kind)
    def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _find(texts, None, index, final)

    return first


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    keep: tuple[str, ...] | None = ("doc_id",),
    item_col: str = "item_id",
    width: int = 10,
    block_windows: int = 200_000,
) -> DataFrame:
    """(*keep, n_words, n_hit, n_items, items, contaminated) for each row of ``docs``.

    Words are runs of a-z, digits and characters beyond ASCII, after lower-casing A-Z. Each run of
    ``width`` words of an item is a window, a shorter item is one window as a whole. A document's
    word is hit if it lies in any occurrence of a window; ``items`` are the sorted ids, as strings,
    of items with occurring windows. Null texts have no words; items without words or with a null
    id are ignored; rows of ``items`` that share an id are one item. Rows of ``docs`` are
    judged one by one, so repeated rows and null ids keep their own results; very long texts are read whole. Columns
    not in ``keep`` are ignored, and those in it may not have the name of a result; if it is None, a
    struct ``row`` of all columns, of any names, stands in their place. Empty tables are allowed: without items nothing is hit.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    # Rows stay in the JVM; only texts, and what was found in them, pass through Python.
    current = docs.select(F.struct("*").alias("row"))
    text = F.col("row").getField(text_col).cast("string")
    windows = scratch.save(
        items.where(F.col(quoted(item_col)).isNotNull())
        .select(F.col(quoted(item_col)).cast("string").alias("item"), F.col("text").cast("string").alias("text"))
        .mapInArrow(lambda b: windows_of(b, width), "item string, words array<long>")
        .groupBy("words")
        .agg(F.collect_set("item").alias("items")),
        "windows",
    )
    n_blocks = max(1, -(-windows.count() // block_windows))
    texts = current.select(text.alias("text"))
    # One scan counts the words of all windows, as long as they fit in the bound; beyond it, each block's own are counted.
    every = windows.select(F.explode("words").alias("w")).distinct().limit(MOST_WORDS + 1).toArrow().column("w").to_numpy().view(U64)
    often = _frequencies(texts, np.sort(every)) if 0 < len(every) <= MOST_WORDS else {}
    for block in range(n_blocks):
        own = windows.where(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == block) if n_blocks > 1 else windows
        rows = own.toArrow().combine_chunks()
        words, names = rows.column("words").combine_chunks(), rows.column("items").to_pylist()
        values, cut = np.asarray(words.values, np.int64).view(U64), np.asarray(words.offsets)
        index = Index([values[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], names)
        index.order(_frequencies(texts, np.unique(values)) if len(every) > MOST_WORDS else often)
        final = block == n_blocks - 1
        found = _finder(index, block > 0, final)(text, *(["found"] if block else []))
        current = current.select("row", found.alias("found"))
        if not final and block % STAGED == STAGED - 1:
            current = scratch.save(current, "spans")
    kept = [F.col("row").getField(c).alias(c) for c in keep] if keep is not None else ["row"]
    return current.select(
        *kept, "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"), "found.items",
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def items_digest(items: str = "items"):
    return F.sha2(F.array_join(items, ","), 256)
