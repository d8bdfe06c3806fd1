"""Substring deduplication by level-wise doubling.

A window of ``width`` words can only repeat if its parts do. At the first level, windows of half
the width are compared, and of these only samples: the one with the least hash in each window of
the full width (its anchor). Equal windows have equal anchors at equal places, so nothing is
missed, and a sixth of all positions is shuffled. Only windows whose anchor repeats are extended
to twice the length, where all of them are compared and those that start earlier elsewhere are
found; no candidate is left for a further level.

Documents are written in blocks, which ask shards of anchors and then of windows about what they hold
(see ``shards``). A block names a window once however often it holds it, so a passage that fills a
third of the corpus meets in one place with one row a block, not one an occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import textblocks as tb
from quillstone.llm.scratch import Scratch
from quillstone.llm.shards import answers_by_block, batch_of, by_shard, cuts, expand, shard_bits, sharded, squeeze

U64 = np.uint64
#: Bytes of text in a block, one document at least.
BLOCK_BYTES = 4 << 20
#: Low bits of an anchor's order that hold its place in the block.
PLACE = U64((1 << 28) - 1)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width``, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = np.minimum(out[: len(out) - step], out[step:]), have + step
    return out


def window_anchors(found: tb.Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows that lie in one document, the place of each one's anchor, and its hash.

    Candidates are ordered by the upper bits of their hashes, then by place: equal windows agree.
    """
    half = width // 2
    n = len(found.hash)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    halves = tb.sequences(found.hash, half)
    place = np.arange(len(halves), dtype=U64)
    least = sliding_least(halves & ~PLACE | place, width - half + 1) & PLACE
    starts = np.flatnonzero(tb.left_in_document(found)[: n - width + 1] >= width)
    at = least[starts].astype(np.int64)
    return starts, at, halves[at]


def _encoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents (id, text): their ids, sizes and texts, compressed."""
    task, serial = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, offsets = tb.flat(batch.column("text"))
        ids = batch.column("id")
        for at, to in tb.slices(offsets, BLOCK_BYTES):
            own = ids.slice(at, to - at)
            known = np.asarray(own.is_valid())
            yield batch_of(
                [(
                    (task << 32) + serial, squeeze(np.asarray(own.fill_null(0), np.int64)), squeeze(known.astype(np.uint8)),
                    squeeze(np.diff(offsets[at : to + 1])), zstandard.ZstdCompressor(level=3).compress(data[offsets[at] : offsets[to]].tobytes()),
                )],
                [pa.int64(), *[pa.binary()] * 4],
                ["block", "ids", "known", "sizes", "texts"],
            )
            serial += 1


class _Block:
    """A block's words, and its windows of documents with an id."""

    def __init__(self, row: dict, width: int):
        self.ids = expand(row["ids"], np.int64)
        self.known = expand(row["known"], np.uint8).astype(bool)
        offsets = np.concatenate(([0], np.cumsum(expand(row["sizes"], np.int64))))
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"]), np.uint8)
        self.words = found = tb.scan(data, offsets, tb.BLANK_WORDS, fold=False)
        starts, self.place, self.anchor = window_anchors(found, width)
        doc = np.searchsorted(found.first, starts, side="right") - 1
        good = self.known[doc]
        self.starts, self.doc, self.place, self.anchor = starts[good], doc[good], self.place[good], self.anchor[good]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, and which of them stand at several places of the block."""
        _, once = np.unique(self.place, return_index=True)
        anchor, times = np.unique(self.anchor[once], return_counts=True)
        return anchor, times > 1

    def candidates(self, repeated: np.ndarray, width: int) -> None:
        """Keep windows with repeated anchors, in the order of (hashes, id, place), and the first of each."""
        anchor, at = np.unique(self.anchor, return_inverse=True)
        good = repeated[at]
        self.starts, self.doc = self.starts[good], self.doc[good]
        h1 = tb.sequences(self.words.hash, width)[self.starts] if len(self.starts) else np.zeros(0, U64)
        h2 = (tb.sequences(self.words.hash, width, 1)[self.starts] if len(self.starts) else h1).astype(np.uint32)
        row, at = self.ids[self.doc], self.starts - self.words.first[self.doc]
        by = np.lexsort((at, row, h2, h1))
        self.h1, self.h2, self.row, self.at, self.starts = h1[by], h2[by], row[by], at[by], self.starts[by]
        new = np.ones(len(by), bool)
        new[1:] = (self.h1[1:] != self.h1[:-1]) | (self.h2[1:] != self.h2[:-1])
        self.head = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1


def _anchor_requests(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                anchor, twice = _Block(row, width).anchors()
                cut = cuts(anchor, bits)
                yield batch_of(
                    [(s, row["block"], squeeze(anchor[a:b]), squeeze(twice[a:b].astype(np.uint8))) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a],
                    [pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["shard", "block", "keys", "twice"],
                )
            tb.release()

    return run


def _answers(rows: list[dict], said: np.ndarray, sizes: list[int]) -> pa.RecordBatch:
    cut = np.concatenate(([0], np.cumsum(sizes)))
    out = [(r["block"], r["shard"], squeeze(said[a:b].astype(np.uint8))) for r, a, b in zip(rows, cut[:-1], cut[1:])]
    return batch_of(out, [pa.int64(), pa.int32(), pa.binary()], ["block", "shard", "said"])


def _anchor_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Does the anchor repeat, in one block or between blocks?"""
    for rows in by_shard(batches):
        parts = [expand(r["keys"]) for r in rows]
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        twice = np.concatenate([expand(r["twice"], np.uint8) for r in rows])
        times = np.bincount(at, weights=1 + twice, minlength=len(keys))
        yield _answers(rows, times[at] > 1, [len(p) for p in parts])


def _said(answers: list[dict]) -> np.ndarray:
    parts = [expand(r["said"], np.uint8) for r in sorted(answers, key=lambda r: r["shard"])]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _window_requests(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tb.release()
                own = _Block(row, width)
                own.candidates(_said(row.pop("anchors") or []), width)
                head = own.head
                cut = cuts(own.h1[head], bits)
                rows = []
                for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                    if b > a:
                        at = head[a:b]
                        rows.append((s, row["block"], squeeze(own.h1[at]), squeeze(own.h2[at]), squeeze(own.row[at]), squeeze(own.at[at].astype(np.uint32))))
                yield batch_of(rows, [pa.int32(), pa.int64(), *[pa.binary()] * 4], ["shard", "block", "h1", "h2", "row", "at"])
                del own, head, rows
            tb.release()

    return run


def _window_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Does the window start earlier in another block?"""
    for rows in by_shard(batches):
        h1, h2 = (np.concatenate([expand(r[c], k) for r in rows]) for c, k in (("h1", U64), ("h2", np.uint32)))
        row, at = (np.concatenate([expand(r[c], k) for r in rows]) for c, k in (("row", np.int64), ("at", np.uint32)))
        by = np.lexsort((at, row, h2, h1))
        new = np.ones(len(by), bool)
        new[1:] = (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])
        head = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
        said = np.empty(len(by), bool)
        said[by] = (row[by] != row[head]) | (at[by] != at[head])
        yield _answers(rows, said, [len(expand(r["h2"], np.uint32)) for r in rows])


def _kept(found: tb.Words, keep: np.ndarray, a: int, b: int) -> tuple[np.ndarray, list[bytes]]:
    """Of documents a to b of a block: how many words go, and the kept ones with one blank between."""
    first = found.first[a : b + 1]
    own = slice(first[0], first[-1])
    keep, start = keep[own], found.start[own]
    # Kept words and one blank after each, as one run of bytes.
    size = (found.end[own] - start) * keep
    out_at = np.concatenate(([0], np.cumsum(size + keep)))
    source = np.repeat(start[keep] - out_at[:-1][keep], size[keep] + 1) + np.arange(out_at[-1])
    out = found.data[np.minimum(source, max(len(found.data) - 1, 0))] if len(keep) else np.zeros(0, np.uint8)
    out[out_at[1:][keep] - 1] = 32
    total = np.concatenate(([0], np.cumsum(keep)))
    raw, first = out.tobytes(), first - first[0]
    ends = out_at[first].tolist()
    return np.diff(first) - np.diff(total[first]), [raw[x : max(x, y - 1)] for x, y in zip(ends[:-1], ends[1:])]


def _remover(width: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tb.release()
                own = _Block(row, width)
                own.candidates(_said(row["anchors"] or []), width)
                head = own.head[own.of] if len(own.of) else own.of
                gone = (own.row != own.row[head]) | (own.at != own.at[head])
                gone |= _said(row["windows"] or [])[own.of] if len(own.of) else gone
                ids, known, found, starts = own.ids, own.known, own.words, own.starts[gone]
                # The candidates' columns are many times the texts; only words are needed from here on.
                del own, head, gone
                n = len(found.hash)
                change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + width, minlength=n + 1)
                keep = np.cumsum(change[:n]) == 0
                del change
                removed, digests, kept = [], [], []
                for a, b in tb.slices(found.offsets):
                    gone, parts = _kept(found, keep, a, b)
                    removed.append(gone)
                    digests += [hashlib.sha256(t).hexdigest() for t in parts]
                    kept += [t.decode() for t in parts] if texts else []
                columns = {
                    "id": pa.array(ids, mask=~known), "n_words": pa.array(found.counts()),
                    "n_removed": pa.array(np.concatenate(removed)), "kept_sha256": pa.array(digests, pa.string()),
                }
                if texts:
                    columns["kept_text"] = pa.array(kept, pa.string())
                del found, keep, starts
                yield pa.record_batch(list(columns.values()), names=list(columns))
            tb.release()

    return run


def remove_repeated_windows(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 20, with_text: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a window is ``width`` consecutive words of one
    document (an even number). Each word covered by a window whose words also start earlier (in a
    document with a smaller id, or earlier in the same one) is removed; windows are judged on
    the input. Kept words are joined by one blank. A null text has no words. A row with a null
    id is left as it is and removes nothing. Rows that repeat an id are judged as one document
    that holds the same windows again, at the same places: these do not start earlier. Extra columns
    are ignored, an empty table gives an empty result.
    """
    if width % 2:
        raise ValueError("width must be even")
    scratch = Scratch(docs.sparkSession, "substring-dedup", packed=True)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = scratch.save(
        texts.mapInArrow(_encoder, "block long, ids binary, known binary, sizes binary, texts binary"), "blocks"
    )
    bits = shard_bits(blocks.count())
    answer = "block long, shard int, said binary"
    asked = blocks.mapInArrow(_anchor_requests(width, bits), "shard int, block long, keys binary, twice binary")
    anchors = scratch.save(sharded(asked, bits).mapInArrow(_anchor_answers, answer), "anchors")
    told = answers_by_block(anchors, "shard", "said").withColumnRenamed("got", "anchors")
    known = blocks.join(told.hint("shuffle_hash"), "block", "left")
    asked = known.mapInArrow(
        _window_requests(width, bits), "shard int, block long, h1 binary, h2 binary, row binary, at binary"
    )
    windows = scratch.save(sharded(asked, bits).mapInArrow(_window_answers, answer), "windows")
    told = answers_by_block(windows, "shard", "said").withColumnRenamed("got", "windows")
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    out = known.join(told.hint("shuffle_hash"), "block", "left").mapInArrow(_remover(width, with_text), schema)
    return out.withColumnRenamed("id", id_col)
