"""Packing of tokenised documents into sequences of a fixed length.

Only the histogram of piece lengths (one number per length, whatever the corpus) reaches the
driver. There, patterns of one to three length classes that fill a sequence are enumerated,
their repeat counts fitted to the histogram by non-negative least squares and rounded, and the
residual packed best-fit, again on the histogram. The plan gives each run of equal lengths its
sequences and offsets; pieces find their place by their rank among pieces of the same length.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm import textblocks as tb
from quillstone.llm.scratch import Scratch, local_table

#: Distinct words whose ids a worker keeps, in each of two generations. With those that a megabyte of text may add
#: they stay under 349,525, beyond which a dictionary doubles its table.
CACHED_WORDS = 300_000
#: Bytes of text that are encoded at a time.
ENCODED_BYTES = 1 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
#: ASCII marks other than the apostrophe, which may begin a token of letters.
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Second bytes, after 0xC3, of capital and of small letters; 0x97 and 0xB7 are signs.
_CAPITAL = np.zeros(256, bool)
_CAPITAL[[*range(0x80, 0x97), *range(0x98, 0x9F)]] = True
_SMALL = np.zeros(256, bool)
_SMALL[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True

#: Stretches of small letters, which the tokenizer neither changes nor parts, and its characters for their bytes.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_CHARACTERS = {**{b: 162 + b for b in range(127, 161)}, 173: 323}


def stretched(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Texts with the same tokens but fewer distinct stretches, and their new offsets.

    Letters of ASCII and Latin-1 in lower case, and a blank between such a letter and a mark: the
    tokenizer does the first and parts tokens there anyway. Texts that may hold a special token's string
    or a combining mark, whose composition depends on case, are left alone.
    """
    raw = data.tobytes()
    if b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw:
        return raw, offsets
    low = _LOWER[data]
    ends = _LETTER[low]
    second = np.flatnonzero(low == 0xC3) + 1
    low[second[_CAPITAL[low[second]]]] += 32
    ends[second[_SMALL[low[second]]]] = True
    cut = ends[:-1] & _MARK[low[1:]]
    starts = offsets[1:-1]
    cut[starts[(starts > 0) & (starts < len(low))] - 1] = False
    at = np.flatnonzero(cut) + 1
    return np.insert(low, at, 32).tobytes(), offsets + np.searchsorted(at, offsets)


class WordIds(dict):
    """Token ids by blank-separated stretches of text.

    The tokenizer drops white space and merges nothing across it, so ids of a text are those of its
    stretches one after another. Stretches are encoded once while they are cached: in two
    generations, of which the older is dropped when the younger, this dictionary, is full. Those of small letters
    only go to the tokenizer's model directly, past the steps that would leave them as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are laid out for little-endian machines with 32-bit integers")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, stretch: bytes) -> bytes:
        ids = self.older.get(stretch)
        if ids is None:
            if _PLAIN(stretch):
                letters = stretch.decode("latin-1")
                found = [t.id for t in self.model.tokenize(letters if letters.isascii() else letters.translate(_CHARACTERS))]
            else:
                found = self.tokenizer.encode(stretch.decode(), add_special_tokens=False).ids
            ids = array("I", found).tobytes()
        self[stretch] = ids
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self) > CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        look = self.__getitem__
        return [b"".join(map(look, t.split())) for t in texts]


_ENCODERS: dict[str, WordIds] = {}
tb.keeps("encoders", _ENCODERS.clear)


def encoder(path: str) -> WordIds:
    tb.keep_only("encoders")
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def _cutter(path: str, end_id: int, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            data, offsets = tb.flat(batch.column(1))
            keys = batch.column(0).to_pylist()
            for a, b in tb.slices(offsets, ENCODED_BYTES):
                raw, own = stretched(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                texts = [raw[x:y] for x, y in zip(own[:-1].tolist(), own[1:].tolist())]
                for key, ids in zip(keys[a:b], words.encode(texts)):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at : at + 4 * length]
                        rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            tb.release()
            columns = list(zip(*rows)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)][: 5 + with_ids], names=names[: 5 + with_ids])

    return run


@dataclass
class Plan:
    """Runs of sequences: each uses, for some lengths, a run of pieces of that length at one offset."""

    used: np.ndarray
    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0

    def repeat(self, lengths: list[int], times: int) -> None:
        at = 0
        for n in lengths:
            self.length.append(n)
            self.rank.append(int(self.used[n]))
            self.sequence.append(self.sequences)
            self.offset.append(at)
            self.used[n] += times
            at += n
        self.sequences += times


def patterns(classes: int) -> np.ndarray:
    """All multisets of one to three classes that sum to ``classes``; 0 stands for none."""
    out = [(classes, 0, 0)]
    out += [(i, classes - i, 0) for i in range((classes + 1) // 2, classes)]
    for i in range(-(-classes // 3), classes - 1):
        for j in range(-(-(classes - i) // 2), min(i, classes - i - 1) + 1):
            out.append((i, j, classes - i - j))
    return np.array(out, np.int64)


def non_negative_fit(pattern: np.ndarray, target: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Least squares over x >= 0 of (pieces used by x repeats) - target, by accelerated projected gradients."""
    n = len(target)
    weight = 1 / np.sqrt(target + 1)
    weight[0] = 0
    flat = pattern.ravel()
    # The largest eigenvalue is bounded by the largest row sum of A'A.
    each = weight[pattern].sum(axis=1)
    step = 1 / np.max(np.bincount(flat, weights=np.repeat(each, 3), minlength=n) * weight)
    x = y = np.zeros(len(pattern))
    t = 1.0
    for _ in range(rounds):
        r = (np.bincount(flat, weights=np.repeat(y, 3), minlength=n) - target) * weight**2
        nxt = np.maximum(y - step * r[pattern].sum(axis=1), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def best_fit(left: np.ndarray, capacity: int, plan: Plan) -> None:
    """Pack what is left: the longest piece, then again and again the longest that still fits."""
    there = [int(n) for n in np.flatnonzero(left)]
    while there:
        chosen: list[int] = []
        room, need = capacity, {}
        k = len(there)
        while k:
            n = there[k - 1]
            if n <= room and left[n] > need.get(n, 0):
                chosen.append(n)
                need[n] = need.get(n, 0) + 1
                room -= n
                k = bisect_right(there, room, 0, k)
            else:
                k = bisect_right(there, min(room, n - 1), 0, k)
        times = min(int(left[n]) // m for n, m in need.items())
        plan.repeat(chosen, times)
        for n, m in need.items():
            left[n] -= m * times
            if not left[n]:
                there.remove(n)


def plan_packing(histogram: np.ndarray, capacity: int, quantum: int) -> Plan:
    """A plan for ``histogram[n]`` pieces of each length n, with length classes of ``quantum`` tokens."""
    plan = Plan(np.zeros(capacity + 1, np.int64))
    left = histogram.astype(np.int64).copy()
    classes = capacity // quantum
    of = -(-np.arange(capacity + 1) // quantum)
    target = np.bincount(of, weights=left, minlength=classes + 1)
    pattern = patterns(classes)
    x = non_negative_fit(pattern, target)
    there = [int(n) for n in np.flatnonzero(left)]

    def longest(low: int, high: int, need: dict[int, int]) -> int:
        """The longest piece left with low < length <= high, besides those already needed; 0 for none."""
        k = bisect_right(there, high)
        while k and there[k - 1] > low and left[there[k - 1]] <= need.get(there[k - 1], 0):
            k -= 1
        return there[k - 1] if k and there[k - 1] > low else 0

    for p in np.argsort(-x, kind="stable"):
        # Round to the nearest count, as far as pieces are left.
        times = int(x[p] + 0.5)
        if not times:
            break
        slots = [int(c) for c in pattern[p] if c]
        while times:
            chosen, need, room = [], {}, capacity
            for k, c in enumerate(slots):
                # The last slot takes whatever fills the sequence best, so that classes cost no room.
                last = k == len(slots) - 1
                n = longest((c - 1) * quantum, room if last else c * quantum, need)
                if not n:
                    break
                chosen.append(n)
                need[n] = need.get(n, 0) + 1
                room -= n
            if len(chosen) < len(slots):
                break
            run = min(times, *(int(left[n]) // m for n, m in need.items()))
            plan.repeat(chosen, run)
            times -= run
            for n, m in need.items():
                left[n] -= m * run
                if not left[n]:
                    there.remove(n)
    best_fit(left, capacity, plan)
    return plan


def _placer(plan: Plan, shift: int = 40):
    key = (np.array(plan.length, np.int64) << shift) + np.array(plan.rank, np.int64)
    by = np.argsort(key)
    key, rank = key[by], np.array(plan.rank, np.int64)[by]
    sequence, offset = np.array(plan.sequence, np.int64)[by], np.array(plan.offset, np.int64)[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column("rank"))
            at = np.searchsorted(key, (np.asarray(batch.column("length")) << shift) + own, side="right") - 1
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.record_batch(
                [*(batch.column(n) for n in keep), pa.array(sequence[at] + own - rank[at]), pa.array(offset[at])],
                names=[*keep, "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096,
    end_id: int = 1, quanta: tuple[int, ...] = (8, 16), rank_rows: int = 500_000, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for each piece.

    A document is its token ids (a null or empty text has none), then ``end_id``; only longer ones
    are cut, into pieces of ``capacity`` ids. Every piece lies in one sequence of at most
    ``capacity`` ids, offsets are gapless from 0. Of the plans for the given ``quanta`` the one with
    the fewest sequences is used. Repeated rows and null ids are packed as rows of their own;
    other columns are ignored; an empty table gives an empty result. ``tokenizer`` is the path of a
    file on every executor, of a tokenizer that lower-cases and whose tokens never reach across ASCII white space
    or from a letter to a mark, as those of word_bpe_49k.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = scratch.save(rows.mapInArrow(_cutter(tokenizer, end_id, capacity, with_ids), schema), "pieces")
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts:
        histogram[r["length"]] = r["n"]
    plan = min((plan_packing(histogram, capacity, q) for q in quanta if capacity % q == 0), key=lambda p: p.sequences)

    # Ranks: a frequent length is split by a salt, so that no task gets more than about rank_rows of it.
    salts = local_table(
        docs.sparkSession, [(r["length"], -(-r["n"] // rank_rows)) for r in counts], length=pa.int64(), salts=pa.int64()
    )
    salted = pieces.join(F.broadcast(salts), "length").withColumn(
        "salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), "salts")
    )
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("own", F.row_number().over(within) - 1)
        .join(sizes, ["length", "salt"])
        .withColumn("rank", F.col("own") + F.col("before"))
        .select(*pieces.columns, "rank")
    )
    placed = ranked.mapInArrow(_placer(plan), f"{schema}, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
