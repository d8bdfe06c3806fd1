"""Vectorised word scanning over Arrow text columns.

Texts are read as UTF-8 bytes and worked on in blocks of whole documents of about a
megabyte, so that memory follows the block (or the longest single text), never the batch.
Every delimiter is ASCII, hence byte classes and character classes agree. Words are named by
64-bit hashes; sequences of words by 128 bits, from two independent polynomials.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
U64 = np.uint64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


#: How a worker drops what tasks of one kind keep for the next of theirs.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(kind: str, drop: Callable[[], None]) -> None:
    """Tasks of this kind keep something in their worker, which ``drop`` lets go."""
    _KEPT[kind] = drop


def keep_only(kind: str | None) -> None:
    """Let go what tasks of other kinds have kept: a worker serves one stage after another and keeps for one at a time."""
    for other, drop in _KEPT.items():
        if other != kind:
            drop()
    release()


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, seed: int):
        self.base = int(stream(seed, 1)[0]) | 1
        self.drop()

    def drop(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def need(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            keep_only("powers")
            n = 1 << (n - 1).bit_length()
            up, down = np.full(n, self.base, U64), np.full(n, _inverse(self.base), U64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


_BYTES = Powers(3)
_SEQ = (Powers(5), Powers(7))
keeps("powers", lambda: [x.drop() for x in (_BYTES, *_SEQ)])

SPACES = bytes([0x20, *range(0x09, 0x0E)])


def _table(delimiters: bytes) -> np.ndarray:
    keep = np.ones(256, bool)
    keep[list(delimiters)] = False
    return keep


#: Words are runs of anything but blanks and control spaces.
BLANK_WORDS = _table(SPACES)
#: Words are runs of ASCII digits, a-z and anything beyond ASCII (after lower-casing A-Z).
ALNUM_WORDS = _table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

_CODES = stream(11, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words of a block: their hashes, their byte ranges and where each document's begin."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def release() -> None:
    """Give freed memory back to the system; an executor's workers share its limit with the JVM."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes, one document at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def scan(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, fold: bool) -> Words:
    """All words of one block; of a large one, part after part."""
    cut = list(slices(offsets))
    if len(cut) < 2:
        return _scan(data, offsets, keep, fold)
    parts = [_scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], keep, fold) for a, b in cut]
    before = np.cumsum([0, *(len(p.hash) for p in parts)])
    return Words(
        np.concatenate([p.data for p in parts]) if fold else data,
        offsets,
        np.concatenate([p.start + offsets[a] for p, (a, _) in zip(parts, cut)]),
        np.concatenate([p.end + offsets[a] for p, (a, _) in zip(parts, cut)]),
        np.concatenate([p.hash for p in parts]),
        np.concatenate([*(p.first[:-1] + n for p, n in zip(parts, before)), before[-1:]]),
    )


def _scan(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, fold: bool) -> Words:
    if fold:
        data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = keep[data]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1] if n else begins[1:]
    ends = inside[:n] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if len(start):
        up, down = _BYTES.need(n)
        terms = _CODES[data]
        terms *= up[:n]
        terms[~inside[:n]] = 0
        value = np.add.reduceat(terms, start) * down[start]
        value = mix(value + (end - start).astype(U64))
    else:
        value = np.zeros(0, U64)
    return Words(data, offsets, start, end, value, np.searchsorted(start, offsets))


def blocks(texts: pa.Array, keep: np.ndarray, fold: bool, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first document, past the last, words) of each block of a text column."""
    data, offsets = flat(texts)
    for at, to in slices(offsets, limit):
        own = offsets[at : to + 1]
        yield at, to, scan(data[own[0] : own[-1]], own - own[0], keep, fold)
    release()


def sequences(hashes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` words, at its first word; runs may cross documents."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, U64)
    up, down = _SEQ[which].need(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: n - width + 1] + U64(width))


def docs_of(words: Words) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(words.first) - 1), words.counts())


def left_in_document(words: Words) -> np.ndarray:
    """Words from each word to the end of its document, itself included."""
    return np.repeat(words.first[1:], words.counts()) - np.arange(len(words.hash))
