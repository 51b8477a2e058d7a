"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The longest Arrow batch in rows; documents may be long, so the default of 10,000 would hold too much.
BATCH_ROWS = 2000

#: What empties the memos that a Python worker keeps from task to task.
KEPT: list[Callable[[], None]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def let_go() -> None:
    """Empty the memos that tasks of other operators left in this Python worker, and give freed memory back.

    A worker serves one stage after another, so a memo of words would stay beside the arrays of every later one.
    """
    for clear in KEPT:
        clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def give_back(spark: SparkSession) -> None:
    """Let the JVM of each executor collect its garbage and shrink its heap.

    A heap that one stage has grown stays as large beside the Python workers of every later one. One task goes to
    each free core, so to every executor; a JVM that gets none only keeps its heap.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done")).collect()


def held_out(doc_id: str, modulus: int, remainder: int):
    """crc32 of the id's decimal text, modulo; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, from one narrow scan; sizes partitions, never results."""
    return int(df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Different numbers in order, by sorting; ``np.unique`` keeps a table, which takes many times as long."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def ranks(x: np.ndarray) -> np.ndarray:
    """For each number its place among the different numbers in order."""
    order = np.argsort(x)
    ordered = x[order]
    out = np.empty(len(x), np.int32)
    out[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]], dtype=np.int32) if len(x) else 0
    return out
