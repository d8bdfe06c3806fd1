"""Columns of numbers between blocks of texts and shards of keys.

A block asks each shard about the distinct keys that it holds; shards answer in the order asked.
Numbers travel as compressed byte planes. However often a key occurs, a shard meets it once a
block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def squeeze(values: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(data: bytes, kind=np.uint64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def squeeze_few(values: np.ndarray) -> bytes:
    """Doubles of which many are equal: the distinct ones, and each one's place among them."""
    kinds, at = np.unique(values, return_inverse=True)
    if 2 * len(kinds) > len(values):
        return b"\0" + squeeze(np.ascontiguousarray(values, np.float64))
    head = squeeze(kinds)
    return b"\1" + len(head).to_bytes(8, "little") + head + squeeze(at.astype(np.uint32))


def expand_few(data: bytes) -> np.ndarray:
    if data[:1] == b"\0":
        return expand(data[1:], np.float64)
    cut = 9 + int.from_bytes(data[1:9], "little")
    return expand(data[9:cut], np.float64)[expand(data[cut:], np.uint32)]


def batch_of(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """All rows of one shard after another, from batches sorted by shard."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[0]["shard"] != row["shard"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def shard_bits(blocks: int) -> int:
    """As many shards as half the blocks, so that a shard holds about what two blocks do."""
    return max(4, int(blocks).bit_length() - 1)


def sharded(requests: DataFrame, bits: int) -> DataFrame:
    return requests.repartition(1 << bits, "shard").sortWithinPartitions("shard")


def answers_by_block(answers: DataFrame, *fields: str) -> DataFrame:
    """A block's answers in one row; as large as its requests, that is, as a block of texts."""
    return answers.where("block is not null").groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("got"))


def cuts(sorted_keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard's keys begin among sorted 64-bit keys; shards go by their upper bits."""
    return np.searchsorted(sorted_keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
