"""Exchange of hash lists between documents and an index that is cut up by hash.

Documents are dealt into chunks, hashes into buckets. A chunk sends to each bucket one row with the sorted
hashes that it holds, as bytes; a bucket merges what all chunks sent and sends answers back as bytes too.
Rows are few and large, work on them is numpy, and a word or passage that is everywhere is still one entry
for each chunk, so no key is hot. Both numbers follow the size of the input, so tasks stay the same size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 8_000_000
BUCKET_BYTES = 16_000_000
#: Columns of a row between a chunk and a bucket; what a and b hold is up to the operator.
ROWS = "chunk int, bucket int, a binary, b binary"


@dataclass(frozen=True)
class Layout:
    chunks: int
    bits: int

    @staticmethod
    def of(df: DataFrame, n_bytes: int) -> Layout:
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return Layout(max(least, -(-n_bytes // CHUNK_BYTES)), max(3, int(np.ceil(np.log2(max(1, n_bytes / BUCKET_BYTES))))))


def in_chunks(df: DataFrame, layout: Layout, *keys: Column) -> DataFrame:
    """Deal rows into chunks by a hash of ``keys``; one shuffle, reused by every later use of the result."""
    dealt = df.withColumn("chunk", F.pmod(F.xxhash64(*keys), F.lit(layout.chunks)).cast("int"))
    return dealt.repartition(layout.chunks, "chunk")


def by_bucket(sorted_hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Slices of a sorted array, one for each bucket (the top bits) that has hashes."""
    top = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64)
    if not len(top):
        return
    starts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(top)]):
        yield int(top[a]), slice(a, b)


def middle(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the bucket's: with them a fingerprint of 32 + bits bits, which grows with the input."""
    return ((hashes << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def joined(blobs: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All blobs as one array, and the blob that each entry came from."""
    sizes = [len(b) // np.dtype(kind).itemsize for b in blobs]
    return np.frombuffer(b"".join(blobs), kind), np.repeat(np.arange(len(blobs)), sizes)


def block_rows(rows: list[tuple]) -> pa.Table:
    """Rows of (chunk, bucket, a, b) as a table."""
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["chunk", "bucket", "a", "b"])


def summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes in order, and the sum of each one's counts."""
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h)
    h, c = h[order], c[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[starts], np.add.reduceat(c, starts) if len(h) else c


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts in one byte each, those of 255 and more behind in full."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def unpacked_counts(blob: bytes, n: int) -> np.ndarray:
    """The ``n`` counts that :func:`packed_counts` made bytes of."""
    out = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<i8", offset=n)
    return out


def packed_ints(values: np.ndarray) -> bytes:
    """Whole numbers as their distance from the least, in as few bytes each as the largest distance needs."""
    low = int(values.min()) if len(values) else 0
    above = (values.astype(np.int64).view(np.uint64) - np.array(low, np.int64).view(np.uint64)) if len(values) else np.zeros(0, np.uint64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(above.max(initial=0)) < 1 << (8 * w))
    return bytes([width]) + low.to_bytes(8, "little", signed=True) + above.astype(f"<u{width}").tobytes()


def unpacked_ints(blob: bytes, n: int, lists: int = 1) -> list[np.ndarray]:
    """The ``lists`` lists of ``n`` numbers each that :func:`packed_ints` made bytes of, one after another."""
    out, at = [], 0
    for _ in range(lists):
        width, low = blob[at], int.from_bytes(blob[at + 1 : at + 9], "little", signed=True)
        above = np.frombuffer(blob, f"<u{width}", n, at + 9).astype(np.uint64)
        out.append((above + np.array(low, np.int64).view(np.uint64)).view(np.int64))
        at += 9 + n * width
    return out
