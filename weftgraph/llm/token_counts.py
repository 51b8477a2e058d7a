"""Token counts of whole texts by rank-synchronous BPE over ragged arrays (see :mod:`.bpe`)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import small_batches


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    One narrow pass: no shuffle, and each worker's memory is its table, a memo of bounded size and one
    Arrow batch. A null or empty text has 0 bytes and 0 tokens; repeated rows give repeated rows; an empty
    table gives an empty one; other columns are not read. ``over_limit`` is ``n_tokens > limit``.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            n = pa.array(bpe.counts(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
