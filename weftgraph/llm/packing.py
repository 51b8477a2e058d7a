"""Packing by power-of-two decomposition.

A document's ids, closed by an end id, are cut into pieces whose lengths are powers of two: as many of
``max_len`` as fit, then one for each bit set in what is left, longest first. A piece is a sequence of
its own, so none crosses documents and none needs padding; training draws batches from the buckets of
equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import small_batches


def pieces(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids; ``max_len`` is a power of two."""
    whole, rest = divmod(n, max_len)
    return [max_len] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", max_len: int = 1024, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket[, ids]``.

    ``bucket`` is log2 of the length. Sequence ids are unique and follow the scan: partition, then row.
    One narrow pass without a shuffle. A null or empty text is the end id alone, one piece of length 1;
    repeated rows are packed once each; an empty table gives an empty one; other columns are not read.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    small_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema([*fields, *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = vocabulary(path), np.array([end_id], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.ids(batch.column(1))):
                ids, at = np.concatenate([ids, end]), 0
                view = memoryview(ids.tobytes())
                for n in pieces(len(ids), max_len):
                    row = (doc, at, n, zlib.crc32(view[4 * at : 4 * (at + n)]), len(ids))
                    rows.append((*row, ids[at : at + n].astype(np.int32)) if with_ids else row)
                    at += n
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    cut_up = narrow.mapInArrow(cut, kinds).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    cut_up = cut_up.withColumn("bucket", (F.length(F.bin("length")) - 1))
    return cut_up.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", *(["ids"] if with_ids else []))
