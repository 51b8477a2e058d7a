"""Quality rules: statistics of each text, then the frequency of its lines across documents.

Lines are normalised (A-Z lowered, digits to 0, white space to one space) and hashed. For each host the
different documents of each line are counted exactly; a document is known by the hash of its text, so equal texts
count once. A line is boilerplate if more than ``min_docs`` documents and more than the share ``max_share`` of
its host's documents have it; such lines are removed, and a document that keeps too little is depleted and
rejected. The share lets the limit follow the size of a host, so that a group of near copies in a large host is no
boilerplate; the floor keeps small hosts out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .common import let_go, small_batches
from .words import coded, owners, parts, spread

_SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\v\f\r"
_NOT_STARTS = bytes(range(0x80, 0xC0))
_DIGITS = bytes.maketrans(b"123456789", b"0" * 9)

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_WIDE = "doc_id long, host string, th long, " + ", ".join(f"{c} long" for c in STATS) + ", lines array<struct<h: long, w: int>>"


def repeat_words(texts: list[bytes], n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many of them lie in windows of ``n`` words that the text has more than once."""
    at, words, ends = coded(texts)
    sizes, m = np.diff(ends), len(at) - n + 1
    if m <= 0:
        return sizes, np.zeros(len(texts), np.int64)
    # exact: windows get numbers, first of pairs, then of pairs and one more word, then within each text
    key, base = at[:m], max(1, len(words))
    for k in range(1, n):
        key = np.unique(key * base + at[k : k + m], return_inverse=True)[1]
    owner = owners(ends)
    begin = np.flatnonzero(owner[:m] == owner[n - 1 :])
    cell = owner[begin] * m + key[begin]
    _, where, counts = np.unique(cell, return_inverse=True, return_counts=True)
    covered = spread(counts[where] > 1, begin, n, len(at))
    return sizes, np.bincount(owner[covered], minlength=len(texts))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_table(text: bytes) -> tuple[int, dict[int, int]]:
    """Lines equal to an earlier one, and the words of each different normalised line, by its hash."""
    seen: set[bytes] = set()
    again, found = 0, {}
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            if line in seen:
                again += 1
            seen.add(line)
            h = _signed(xxhash.xxh3_64_intdigest(b" ".join(words).lower().translate(_DIGITS)))
            found[h] = found.get(h, 0) + len(words)
    return again, found


def line_stats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Statistics and line hashes of every document; one narrow pass."""
    small_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            texts = batch.column(3).cast(pa.large_binary()).fill_null(b"").to_pylist()
            n_words, repeats = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for low, part in parts(texts):
                n_words[low : low + len(part)], repeats[low : low + len(part)] = repeat_words(part)
            chars, symbols, dups, lines = [], [], [], []
            for t in texts:
                chars.append(len(t.translate(None, _BLANK + _NOT_STARTS)))
                symbols.append(len(t) - len(t.translate(None, _SYMBOLS)))
                again, found = line_table(t)
                dups.append(again)
                lines.append([{"h": h, "w": w} for h, w in found.items()])
            columns = [batch.column(0), batch.column(1), batch.column(2), *(pa.array(c, pa.int64()) for c in (n_words, chars, symbols, dups, repeats)), pa.array(lines, pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "host", "th", *STATS, "lines"])

    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.xxhash64(text).alias("th"), text.alias("text"))
    return narrow.mapInArrow(measure, _WIDE)


def apply_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20, max_share: float = 0.05, min_left: int = 50, min_share: float = 0.3) -> DataFrame:
    """One row per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, left_words, kept, text_hash``.

    ``base_failed``: under 50 words, or over half the words in repeated 3-word windows. Of the others a
    document is kept unless removing its boilerplate lines (those of more than ``min_docs`` documents and more than
    ``max_share`` of the documents of its host) leaves under ``min_left`` words or under ``min_share`` of its words.
    ``left_words`` is what they leave; of a text that fails the base rules no line is removed.

    A null or empty text has no words and fails the base rules. Null hosts are one host. Rows repeated with
    the same id, host and text give one row each. An empty table gives an empty one. Counts are summed in
    tasks before they are shuffled; the join with frequent lines is one that Spark can split by skew.
    """
    wide = written(line_stats(docs, id_col=id_col, text_col=text_col, host_col=host_col), "quality-lines")
    host = F.coalesce(F.concat(F.lit("h"), "host"), F.lit(""))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    line = wide.select("doc_id", "host", "th", failed.alias("base_failed"), host.alias("hk"), F.explode("lines").alias("line")).select("*", F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    documents = wide.select(host.alias("hk"), "th").distinct().groupBy("hk").agg(F.count(F.lit(1)).alias("n_host"))
    counts = line.select("hk", "h", "th").distinct().groupBy("hk", "h").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs)
    frequent = counts.join(documents, "hk").where(F.col("n_docs") > max_share * F.col("n_host")).select("hk", "h")
    hits = line.where("not base_failed").join(frequent, ["hk", "h"], "left_semi").select("doc_id", "host", "th", F.lit(None).cast("struct<" + ",".join(f"{c}:bigint" for c in STATS) + ">").alias("stats"), F.col("w").cast("long").alias("removed"))
    own = wide.select("doc_id", "host", "th", F.struct(*STATS).alias("stats"), F.lit(0).cast("long").alias("removed"))
    both = own.unionByName(hits).groupBy("doc_id", "host", "th").agg(F.max("stats").alias("stats"), F.sum("removed").alias("removed"), F.count("stats").alias("copies"))
    n, left = F.col("stats.n_words"), F.col("stats.n_words") - F.expr("removed div copies")
    bad = (n < 50) | (100 * F.col("stats.n_repeat_words") > 50 * n)
    rows = both.select("doc_id", "stats.*", bad.alias("base_failed"), left.alias("left_words"), (~bad & (left >= min_left) & (left >= min_share * n)).alias("kept"), F.col("th").alias("text_hash"), "copies")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")
