"""Katz backoff language model over words, trained and evaluated in shards.

P(w | context) is the Good-Turing discounted relative frequency of the n-gram where it was seen, and
else alpha(context) times P(w | the context without its first word), and so on; alpha is normalised
exactly, from the mass that the discounts of the context's own n-grams leave and from the mass that the order
below gives to words not seen after the context. P(w) is Good-Turing discounted too, its left-over
mass is the unknown word's.

Texts are encoded once, in blocks, as numbers into the block's own vocabulary, and written. Counts
live in shards: of words by their hash, of n-grams by their context. Order after order, a block asks the shards
for what it holds, each distinct word or n-gram once, with its probability one order below, and evaluates every token
from the answers. Requests and answers are columns of numbers, compressed; frequent contexts are split over shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import textblocks as tb
from quillstone.llm.scratch import Scratch
from quillstone.llm.shards import answers_by_block, batch_of, by_shard, cuts, expand, expand_few, shard_bits, sharded, squeeze, squeeze_few

U64 = np.uint64
#: Hash of the end token, and the number of the context before the first word.
END = U64(1)
BEGIN = U64((1 << 63) + 1)
BLOCK_BYTES = 8 << 20
#: Counts up to this are discounted.
GT = 5


def _encoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents (id, train, text): token numbers, vocabulary, and training counts."""
    task, serial = TaskContext.get().partitionId(), 0
    for batch in batches:
        train = np.asarray(batch.column("train").fill_null(False))
        for at, to, found in tb.blocks(batch.column("text"), tb.BLANK_WORDS, fold=True, limit=BLOCK_BYTES):
            n = found.counts() + 1
            first = np.concatenate(([0], np.cumsum(n)))
            hashes = np.full(first[-1], END, U64)
            inner = np.ones(first[-1], bool)
            inner[first[1:] - 1] = False
            hashes[inner] = np.maximum(found.hash, U64(4))
            vocabulary, stream = np.unique(hashes, return_inverse=True)
            seen = np.bincount(stream[np.repeat(train[at:to], n)], minlength=len(vocabulary))
            yield pa.record_batch(
                [
                    pa.array([(task << 32) + serial]),
                    pa.array([batch.column("id").slice(at, to - at).to_pylist()], pa.list_(batch.schema.field("id").type)),
                    pa.array([squeeze(train[at:to].astype(np.uint8))], pa.binary()),
                    pa.array([squeeze(n.astype(U64))], pa.binary()),
                    pa.array([squeeze(stream.astype(np.uint32))], pa.binary()),
                    pa.array([squeeze(vocabulary)], pa.binary()),
                    pa.array([squeeze(seen.astype(U64))], pa.binary()),
                    pa.array([int(train[at:to].sum())]),
                ],
                names=["block", "ids", "train", "n", "stream", "vocabulary", "seen", "train_docs"],
            )
            serial += 1


def _word_requests(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, seen = expand(row["vocabulary"]), expand(row["seen"])
                cut = cuts(vocabulary, bits)
                rows = [
                    (s, row["block"], squeeze(vocabulary[a:b]), squeeze(seen[a:b]))
                    for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a
                ]
                yield batch_of(rows, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["shard", "block", "words", "seen"])

    return run


def _word_answers(bits: int):
    """For each request the counts and numbers of its words; for each shard how many words have which count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        names = ["block", "shard", "count", "number"]
        for rows in by_shard(batches):
            parts = [expand(r["words"]) for r in rows]
            words, at = np.unique(np.concatenate(parts), return_inverse=True)
            count = np.bincount(at, weights=np.concatenate([expand(r["seen"]) for r in rows]), minlength=len(words)).astype(U64)
            number = np.empty(len(words), U64)
            number[np.argsort(-count.astype(np.int64), kind="stable")] = np.arange(len(words), dtype=U64)
            number = (number << U64(bits)) | U64(rows[0]["shard"])
            cut = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            out = [
                (r["block"], r["shard"], squeeze(count[at[a:b]]), squeeze(number[at[a:b]]))
                for r, a, b in zip(rows, cut[:-1], cut[1:])
            ]
            r, n = np.unique(count, return_counts=True)
            yield batch_of([*out, (None, rows[0]["shard"], squeeze(r), squeeze(n.astype(U64)))], kinds, names)

    return run


def discounts(counts: dict[int, int]) -> np.ndarray:
    """Katz's d_r for r = 0..GT from how many items have which count; 1 for larger r.

    Where the counts of counts allow no Good-Turing estimate between 0 and 1, (r - 1/2) / r.
    """
    d = np.array([1.0, *((r - 0.5) / r for r in range(1, GT + 1))])
    n = [counts.get(r, 0) for r in range(GT + 2)]
    if n[1]:
        common = (GT + 1) * n[GT + 1] / n[1]
        for r in range(1, GT + 1):
            if n[r] and common < 1:
                good = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common)
                if 0 < good < 1:
                    d[r] = good
    return d


@dataclass
class Unigrams:
    """P(w) from a word's count: total, distinct words, discounts, and the unknown word's share."""

    total: int
    distinct: int
    d: np.ndarray
    known: float
    unknown: float

    @classmethod
    def of(cls, counts: dict[int, int]) -> Unigrams:
        counts = {r: n for r, n in counts.items() if r}
        total, distinct = sum(r * n for r, n in counts.items()), sum(counts.values())
        d = discounts(counts)
        mass = sum(n * r * (d[r] if r <= GT else 1.0) for r, n in counts.items()) / max(total, 1)
        unknown = max(1 - mass, 0.5 / (total + 0.5 * (distinct + 1)))
        return cls(total, distinct, d, (1 - unknown) / mass if mass else 0.0, unknown)

    def p(self, count: np.ndarray) -> np.ndarray:
        d = np.where(count <= GT, self.d[np.minimum(count, U64(GT)).astype(np.int64)], 1.0)
        return np.where(count > 0, self.known * d * count / max(self.total, 1), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


@dataclass
class Backoff:
    """Discounts of bigrams, and the sums of contexts that are split over shards."""

    d: np.ndarray
    v: np.ndarray
    few: np.ndarray
    mass: np.ndarray


class Block:
    """A block's tokens: numbers into its vocabulary, whose counts and names the shards have told."""

    def __init__(self, row: dict):
        answers = sorted(row["words"], key=lambda r: r["shard"])
        self.count = np.concatenate([expand(r["count"]) for r in answers])
        self.number = np.concatenate([expand(r["number"]) for r in answers])
        self.n = expand(row["n"]).astype(np.int64)
        self.stream = expand(row["stream"], np.uint32).astype(np.int64)
        self.train = np.repeat(expand(row["train"], np.uint8).astype(bool), self.n)
        self.first = np.concatenate(([0], np.cumsum(self.n)[:-1]))


class Grams:
    """A block's distinct n-grams of one order, in the order of its requests.

    ``context`` numbers each token's context into ``name`` and ``times``, its name for all blocks and its
    count; tokens where ``good`` does not hold have none. ``low`` is each token's probability after the shorter context.
    """

    def __init__(self, block: Block, context: np.ndarray, name: np.ndarray, times: np.ndarray, low: np.ndarray, good: np.ndarray, bits: int, hot: float):
        size, at = len(block.number), np.flatnonzero(good)
        both, first, of = np.unique(context[at] * size + block.stream[at], return_index=True, return_inverse=True)
        c, w = both // size, block.number[both % size]
        v, many = name[c], times[c]
        # A frequent context is dealt over as many shards as it fills.
        split = np.maximum(np.ceil(many / hot), 1).astype(U64)
        shard = (tb.mix(v) + tb.mix(w) % split) & U64((1 << bits) - 1)
        seen = np.bincount(of[block.train[at]], minlength=len(both))
        by = np.lexsort((w, v, shard))
        self.v, self.w, self.shard, self.seen = v[by], w[by], shard[by], seen[by].astype(U64)
        self.context, self.low, self.split = many[by], low[at][first][by], split[by] > 1
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.at = np.full(len(block.stream), -1)
        self.at[at] = place[of]

    def parts(self, bits: int) -> Iterator[tuple[int, int, int]]:
        cut = np.searchsorted(self.shard, np.arange((1 << bits) + 1, dtype=U64))
        for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            if b > a:
                yield s, a, b

    def values(self, answers: list[dict], backoff: Backoff) -> tuple[np.ndarray, np.ndarray]:
        """Training count and probability of each n-gram."""
        answers = sorted(answers, key=lambda r: r["shard"])
        if not answers:
            return np.zeros(0, U64), np.zeros(0)
        r = np.concatenate([expand(x["count"]) for x in answers])
        few = np.concatenate([expand(x["few"], np.uint32) for x in answers]).reshape(-1, GT).astype(np.float64)
        mass = np.concatenate([expand_few(x["mass"]) for x in answers])
        # A context begins anew where the shard changes: as the requests had it.
        new = np.concatenate(([True], (self.v[1:] != self.v[:-1]) | (self.shard[1:] != self.shard[:-1])))
        of = np.cumsum(new) - 1
        v, context = self.v[new], self.context[new].astype(np.float64)
        if len(backoff.v):
            place = np.minimum(np.searchsorted(backoff.v, v), len(backoff.v) - 1)
            here = backoff.v[place] == v
            few[here], mass[here] = backoff.few[place[here]], backoff.mass[place[here]]
        # Mass that discounting takes from the context's own n-grams, over what unseen words have.
        left = (few * np.arange(1, GT + 1) * (1 - backoff.d[1:])).sum(axis=1) / np.maximum(context, 1)
        # A context without discounted n-grams gives half a count to unseen words.
        scale = np.where((left > 0) | (context == 0), 1.0, context / (context + 0.5))
        left = np.where(left > 0, left, 1 - scale)
        alpha = np.where(context > 0, left / np.maximum(1 - mass, 1e-300), 1.0)
        d = np.where(r <= GT, backoff.d[np.minimum(r, U64(GT)).astype(np.int64)], 1.0)
        return r, np.where(r > 0, scale[of] * d * r / np.maximum(context[of], 1), alpha[of] * self.low)


@dataclass
class Orders:
    """What all blocks know: the unigrams, and the backoff of each order from the second that is counted."""

    bits: int
    hot: float
    train_docs: int
    unigrams: Unigrams
    backoffs: list[Backoff]

    def climb(self, block: Block, row: dict) -> tuple[Grams, np.ndarray]:
        """The n-grams of the order after those that are counted, and each token's log10 probability below it.

        An order's probability is that of its n-gram where it was seen, and else its context's backoff weight
        times the probability one order below, and so on down to the unigrams.
        """
        size = len(block.number)
        context = np.empty_like(block.stream)
        context[1:] = block.stream[:-1]
        context[block.first] = size
        value = self.unigrams.p(block.count)[block.stream]
        name, times = np.append(block.number, BEGIN), np.append(block.count, U64(self.train_docs))
        good = np.ones(len(value), bool)
        grams = Grams(block, context, name, times, value, good, self.bits, self.hot)
        for k, backoff in enumerate(self.backoffs):
            r, p = grams.values(row[f"grams{k + 2}"] or [], backoff)
            good = grams.at >= 0
            value = value.copy()
            value[good] = p[grams.at[good]]
            # The context of the next order is the n-gram that ends before the token, in the same document.
            context = np.full(len(value), -1)
            context[1:] = grams.at[:-1]
            context[block.first] = -1
            name = tb.mix(tb.mix(grams.v + U64(k + 1)) ^ (grams.w * U64(0x9E3779B97F4A7C15)))
            grams = Grams(block, context, name, r, value, context >= 0, self.bits, self.hot)
        return grams, value


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))), len(values))


def _gram_requests(orders: Orders):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        names = ["shard", "block", "v", "many", "split", "w", "low", "seen"]
        for batch in batches:
            for row in batch.to_pylist():
                tb.release()
                g, _ = orders.climb(Block(row), row)
                rows = []
                for s, a, b in g.parts(orders.bits):
                    at = runs(g.v[a:b])
                    v = g.v[a:b][at[:-1]]
                    rows.append((
                        s, row["block"], squeeze(v), squeeze(np.diff(at).astype(U64)), squeeze(g.split[a:b][at[:-1]].astype(np.uint8)),
                        squeeze(g.w[a:b]), squeeze_few(g.low[a:b]), squeeze(g.seen[a:b]),
                    ))
                yield batch_of(rows, kinds, names)

    return run


def _gram_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each request its n-grams' counts, and what the backoff of its contexts needs where one was not seen."""
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["block", "shard", "count", "few", "mass"]
    for rows in by_shard(batches):
        vs, many = [expand(r["v"]) for r in rows], [expand(r["many"]).astype(np.int64) for r in rows]
        ws = [expand(r["w"]) for r in rows]
        contexts, v_of = np.unique(np.concatenate(vs), return_inverse=True)
        v = np.repeat(v_of, np.concatenate(many))
        w = np.concatenate(ws)
        words, w_of = np.unique(w, return_inverse=True)
        keys, first, at = np.unique(v * len(words) + w_of, return_index=True, return_inverse=True)
        count = np.bincount(at, weights=np.concatenate([expand(r["seen"]) for r in rows]), minlength=len(keys)).astype(U64)
        kept = count > 0
        owner = (keys // len(words))[kept]
        low = np.concatenate([expand_few(r["low"]) for r in rows])[first][kept]
        mass = np.bincount(owner, weights=low, minlength=len(contexts))
        few = np.stack([np.bincount(owner[count[kept] == r], minlength=len(contexts)) for r in range(1, GT + 1)], axis=1).astype(np.uint32)
        out, gram_at, v_at = [], 0, 0
        for r, own_v, own_w in zip(rows, vs, ws):
            got = count[at[gram_at : gram_at + len(own_w)]]
            c = v_of[v_at : v_at + len(own_v)]
            out.append((r["block"], r["shard"], squeeze(got), squeeze(few[c].ravel()), squeeze_few(mass[c])))
            gram_at, v_at = gram_at + len(own_w), v_at + len(own_v)
        r, n = np.unique(count[count <= GT + 1], return_counts=True)
        out.append((None, rows[0]["shard"], squeeze(np.concatenate((r, n.astype(U64)))), None, None))
        split = np.unique(np.concatenate([x[expand(r["split"], np.uint8) > 0] for x, r in zip(vs, rows)]))
        if len(split):
            c = np.searchsorted(contexts, split)
            out.append((None, rows[0]["shard"], squeeze(split), squeeze(few[c].ravel()), squeeze_few(mass[c])))
        yield batch_of(out, kinds, names)


def _scorer(orders: Orders):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids in zip(batch.drop_columns(["ids"]).to_pylist(), batch.column("ids")):
                tb.release()
                block = Block(row)
                last = Orders(orders.bits, orders.hot, orders.train_docs, orders.unigrams, orders.backoffs[:-1])
                grams, value = last.climb(block, row)
                _, p = grams.values(row[f"grams{len(orders.backoffs) + 1}"] or [], orders.backoffs[-1])
                value, good = value.copy(), grams.at >= 0
                value[good] = p[grams.at[good]]
                doc = np.repeat(np.arange(len(block.n)), block.n)
                total = lambda x: np.bincount(doc, weights=x, minlength=len(block.n))  # noqa: B023, E731
                count = block.count[block.stream]
                yield pa.record_batch(
                    [
                        ids.values,
                        pa.array(block.n),
                        pa.array(total(count > 0).astype(np.int64)),
                        pa.array(np.full(len(block.n), orders.unigrams.total)),
                        pa.array(total(orders.unigrams.base(count))),
                        pa.array(total(np.log10(value))),
                    ],
                    names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def katz_scores(
    docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, hot_context: int = 1_000_000
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    Learns from the rows for which ``train`` holds (null: not). Tokens are words
    ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end token; a null text has only that.
    ``base_score`` is add-half smoothing of the tokens' training counts, ``score`` the model's log10
    probability of the tokens, of n-grams up to ``order`` (2 at least) words. Very long texts are read whole, as a block of their own. Repeated rows and null ids are rows of their own; extra columns are
    ignored. With nothing to learn from, every token is the unknown word; an empty table gives an
    empty result. Contexts of more than ``hot_context`` occurrences (or a 65536th of all) are
    split over shards.
    """
    scratch = Scratch(docs.sparkSession, "katz")
    rows = docs.select(F.col(id_col).alias("id"), train.alias("train"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    blocks = scratch.save(
        rows.mapInArrow(
            _encoder,
            f"block long, ids array<{kind.simpleString()}>, train binary, n binary, stream binary, vocabulary binary, seen binary, train_docs long",
        ),
        "blocks",
    )
    size = blocks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("train_docs"), F.lit(0)).alias("docs")).first()
    bits = shard_bits(size["n"])

    asked = blocks.select("block", "vocabulary", "seen").mapInArrow(_word_requests(bits), "shard int, block long, words binary, seen binary")
    words = scratch.save(
        sharded(asked, bits).mapInArrow(_word_answers(bits), "block long, shard int, count binary, number binary"), "words"
    )
    counts: dict[int, int] = {}
    for r in words.where("block is null").select("count", "number").toLocalIterator():
        for c, n in zip(expand(bytes(r["count"])).tolist(), expand(bytes(r["number"])).tolist()):
            counts[c] = counts.get(c, 0) + n
    unigrams = Unigrams.of(counts)
    orders = Orders(bits, float(max(hot_context, unigrams.total >> 16)), size["docs"], unigrams, [])

    told = answers_by_block(words, "shard", "count", "number").withColumnRenamed("got", "words")
    known = blocks.select("block", "ids", "train", "n", "stream").join(told.hint("shuffle_hash"), "block")
    for k in range(2, order + 1):
        asked = known.drop("ids").mapInArrow(
            _gram_requests(orders),
            "shard int, block long, v binary, many binary, split binary, w binary, low binary, seen binary",
        )
        grams = scratch.save(
            sharded(asked, bits).mapInArrow(_gram_answers, "block long, shard int, count binary, few binary, mass binary"), f"grams{k}"
        )
        orders = Orders(bits, orders.hot, orders.train_docs, unigrams, [*orders.backoffs, _backoff(grams)])
        told = answers_by_block(grams, "shard", "count", "few", "mass").withColumnRenamed("got", f"grams{k}")
        known = known.join(told.hint("shuffle_hash"), "block", "left")
    scored = known.mapInArrow(
        _scorer(orders),
        f"id {kind.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return scored.withColumnRenamed("id", id_col)


def _backoff(pairs: DataFrame) -> Backoff:
    """Sums over shards: a few numbers each, and the contexts that are split, of which there are 65536 at most."""
    counts: dict[int, int] = {}
    split: dict[int, np.ndarray] = {}
    for r in pairs.where("block is null").toLocalIterator():
        values = expand(bytes(r["count"]))
        if r["few"] is None:
            half = len(values) // 2
            for c, n in zip(values[:half].tolist(), values[half:].tolist()):
                counts[c] = counts.get(c, 0) + n
        else:
            few = expand(bytes(r["few"]), np.uint32).reshape(-1, GT)
            for v, f, m in zip(values.tolist(), few, expand_few(bytes(r["mass"]))):
                split[v] = split.get(v, 0) + np.append(f, m)
    counts.pop(0, None)
    v = np.array(sorted(split), U64)
    sums = np.array([split[int(x)] for x in v]).reshape(len(v), GT + 1)
    return Backoff(discounts(counts), v, sums[:, :GT], sums[:, GT])
