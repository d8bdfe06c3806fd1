"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has one row of language bits per slot: an n-gram sets its languages'
bits in each of its slots, and the AND of these slots gives, in one look-up, all languages that
contain the n-gram. A text's n-grams are counted per language, the counts corrected for the
slices' false-positive rates, and the language with the most n-grams wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm import textblocks as tb
from quillstone.llm.scratch import bounded_batches, local_table, quoted

U64 = np.uint64
SLOT_BITS, PROBES = 20, 2
#: Bytes of text that are judged at a time; arrays of several times that size are made of them.
JUDGED_BYTES = 1 << 18
_LETTER = regex.compile(r"\p{L}")

#: Bytes of a text as the n-grams see them: ASCII letters in lower case, anything beyond ASCII, the rest blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte n-grams whose middle is no blank, and words of one byte: their values, and where each document's begin.

    A document stands between blanks (one before it, two after it), so short texts have n-grams too and none
    reaches into the next document.
    """
    size = np.diff(offsets)
    padded = np.full(len(data) + 3 * len(size), 32, np.uint8)
    padded[np.arange(len(data)) + np.repeat(3 * np.arange(len(size)) + 1, size)] = _FOLD[data]
    b = padded
    n = max(len(b) - 3, 0)
    wide = b.astype(np.uint32)
    value = wide[:n] | (wide[1 : n + 1] << np.uint32(8)) | (wide[2 : n + 2] << np.uint32(16)) | (wide[3 : n + 3] << np.uint32(24))
    blank = b == 32
    lone = blank[:n] & ~blank[1 : n + 1] & blank[2 : n + 2]
    value[lone] = (value[lone] & np.uint32(0xFFFFFF)) | np.uint32(32 << 24)
    at = np.flatnonzero(lone | (~blank[1 : n + 1] & ~blank[2 : n + 2]))
    return value[at], np.searchsorted(at, offsets + 3 * np.arange(len(offsets)))


def slots(value: np.ndarray) -> list[np.ndarray]:
    h = tb.mix(value.astype(U64) + U64(0x9E3779B97F4A7C15))
    return [((h >> U64(64 - SLOT_BITS * (k + 1))) & U64((1 << SLOT_BITS) - 1)).astype(np.int32) for k in range(PROBES)]


@dataclass
class LanguageFilter:
    """Slices of up to eight languages each: ``bits[slice]`` has a byte of language bits per slot."""

    languages: list[str]
    bits: list[np.ndarray]

    @classmethod
    def build(cls, found: dict[str, np.ndarray], sizes: dict[str, int]) -> LanguageFilter:
        languages = sorted(found, key=lambda x: (-sizes[x], x))
        bits = [np.zeros(1 << SLOT_BITS, np.uint8) for _ in range(-(-len(languages) // 8))]
        for k, name in enumerate(languages):
            for at in slots(found[name]):
                bits[k // 8][at] |= np.uint8(1 << k % 8)
        return cls(languages, bits)

    def rates(self) -> np.ndarray:
        """False-positive rate of each language: its slots' fill to the power of the probes."""
        return np.array([((self.bits[k // 8] >> (k % 8)) & 1).mean() ** PROBES for k in range(len(self.languages))])

    def counts(self, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(documents, languages): n-grams of each document that each language contains, corrected."""
        at = slots(value)
        n = np.diff(first)
        out = np.zeros((len(n), len(self.languages)))
        rates = self.rates()
        for s, bits in enumerate(self.bits):
            mask = bits[at[0]]
            for a in at[1:]:
                mask = mask & bits[a]
            for k in range(8 * s, min(8 * s + 8, len(self.languages))):
                total = np.concatenate(([0], np.cumsum((mask >> np.uint8(k % 8)) & np.uint8(1), dtype=np.int64)))
                hits = total[first[1:]] - total[first[:-1]]
                out[:, k] = np.clip((hits - rates[k] * n) / (1 - min(rates[k], 0.999)), 0, None)
        return out


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tb.keep_only(None)
    for batch in batches:
        names = batch.column("lang").to_pylist()
        data, offsets = tb.flat(batch.column("text"))
        for at, to in tb.slices(offsets):
            own = offsets[at : to + 1]
            value, first = grams(data[own[0] : own[-1]], own - own[0])
            for name in set(names[at:to]):
                rows = np.array([x == name for x in names[at:to]])
                values, n = np.unique(value[np.repeat(rows, np.diff(first))], return_counts=True)
                yield pa.record_batch(
                    [pa.array([name] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(n)],
                    names=["lang", "gram", "n"],
                )


def train(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    sample_docs: int = 3000, top_grams: int = 4_000, most_languages: int = 1_000,
) -> LanguageFilter:
    """Filters of the ``top_grams`` most frequent n-grams of each language.

    Learns from a sample: rows are taken by a hash of their id so that about ``sample_docs`` of each
    language are expected (all of a language that has fewer). Rows with a null text or language
    teach nothing; nor do the labels beyond the ``most_languages`` most frequent ones, which are no languages in
    number. Rarer n-grams than the ``top_grams`` are mostly names and typing errors, which any language may have;
    with them the filters would fill up. The driver receives ``top_grams`` rows a language. An empty table gives a model that knows nothing.
    """
    rows = docs.select(
        F.col(quoted(text_col)).cast("string").alias("text"), F.col(quoted(lang_col)).cast("string").alias("lang"),
        F.pmod(F.xxhash64(F.lit("language sample"), F.col(quoted(id_col))), F.lit(1 << 30)).alias("draw"),
    ).where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.orderBy(F.desc("size"), "lang").limit(most_languages)
    names = {r["lang"]: r["size"] for r in sizes.collect()}
    if not names:
        return LanguageFilter([], [])
    known = local_table(docs.sparkSession, list(names.items()), lang=pa.string(), size=pa.int64())
    sample = rows.join(F.broadcast(known), "lang").where(F.col("draw") * F.col("size") < sample_docs * (1 << 30))
    counted = (
        sample.select("text", "lang").mapInArrow(_count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top_grams).select("lang", "gram").toArrow()
    lang, gram = np.array(top.column("lang").to_pylist(), object), top.column("gram").to_numpy()
    return LanguageFilter.build({x: gram[lang == x].astype(np.uint32) for x in set(lang.tolist())}, names)


def _judge(texts: pa.Array, model: LanguageFilter) -> tuple[pa.Array, pa.Array]:
    """The predicted language and the score of each text."""
    names = np.array([*model.languages, "und"], object)
    data, offsets = tb.flat(texts)
    pick, score = [np.zeros(0, np.int64)], [np.zeros(0)]
    for at, to in tb.slices(offsets, JUDGED_BYTES):
        own = offsets[at : to + 1]
        block = data[own[0] : own[-1]]
        own = own - own[0]
        value, first = grams(block, own)
        n = np.diff(first)
        got = model.counts(value, first) if model.languages else np.zeros((len(n), 1))
        letters = ((block | 32) >= 97) & ((block | 32) <= 122) & (block < 128)
        total = np.concatenate(([0], np.cumsum(letters)))
        letters = total[own[1:]] > total[own[:-1]]
        for d in np.flatnonzero(~letters):  # no ASCII letter: look for any other
            letters[d] = bool(_LETTER.search(block[own[d] : own[d + 1]].tobytes().decode()))
        best = got.argmax(axis=1) if model.languages else np.zeros(len(n), np.int64)
        pick.append(np.where(letters, best, len(model.languages)))
        share = got.max(axis=1) / np.maximum(n, 1)
        score.append(np.where(letters, np.clip(share, 0, 1), 0.0))
    tb.release()
    return pa.array(names[np.concatenate(pick)].tolist(), pa.string()), pa.array(np.concatenate(score), pa.float64())


def predicted(text: Column, model: LanguageFilter) -> Column:
    """A struct (lang_pred, score) for a text column; nothing but the texts leaves the JVM."""

    @F.arrow_udf("lang_pred string, score double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tb.keep_only(None)
        for texts in batches:
            yield pa.StructArray.from_arrays(_judge(texts, model), names=["lang_pred", "score"])

    return judge(text.cast("string"))


def predict(
    docs: DataFrame, model: LanguageFilter, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """(*keep, lang_pred, score) of each row; only the text is looked at.

    ``score`` is the corrected share of the text's n-grams that its language contains. A text that
    is null or without letters is ``und`` with score 0, and so is every text if nothing was
    learnt. Ties go to the language with more training rows, and with them texts that share no n-gram with
    any language, with score 0; repeated rows get equal results. Very
    long texts are read whole, an empty table gives an empty result. Columns that are not in ``keep`` are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(*(F.col(quoted(c)).alias(f"k{n}") for n, c in enumerate(keep)), predicted(F.col(quoted(text_col)), model).alias("found"))
    return rows.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(keep)), "found.lang_pred", "found.score")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id, which is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n)), F.lit(-1))
