"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is bound as the product of its letters' vectors,
each permuted (rotated) by its place; a text is bundled as the sum over its n-grams; a language is bundled
from all its training texts. A text goes to the language whose prototype has the largest cosine with it.

Words are runs of letters, in lower case, with a border mark on either side, so that n-grams never join words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let_go, mix, small_batches

DIM = 512
GRAM = 3
PART_CHARS = 500_000


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case (one code point), and whether it is a letter."""
    n = 0x110000
    lower, letter = np.arange(n, dtype=np.uint32), np.zeros(n, bool)
    for c in range(n):
        x = chr(c)
        if x.isalpha():
            letter[c] = True
            y = x.lower()
            lower[c] = ord(y) if len(y) == 1 else c
    return lower, letter


def letter_vectors(codes: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """+1/-1 vectors of code points, the same on every machine."""
    with np.errstate(over="ignore"):
        cells = codes.astype(np.uint64)[:, None] * np.uint64(dim) + np.arange(dim, dtype=np.uint64)[None]
        bits = mix(cells + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
    return (bits.astype(np.int8) << 1) - np.int8(1)


def gram_vectors(grams: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Bind n-grams (rows of code points): the letter at place p is rotated by n-1-p, then all are multiplied."""
    codes, where = np.unique(grams, return_inverse=True)
    letters, where = letter_vectors(codes, dim, seed), where.reshape(grams.shape)
    n = grams.shape[1]
    out = letters[where[:, n - 1]]
    for p in range(n - 1):
        out = out * np.roll(letters, n - 1 - p, axis=1)[where[:, p]]
    return out


def _places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``np.unique(keys, return_inverse=True)`` for keys in 0..size-1; by a table where that is small."""
    if size > 4_000_000:
        return np.unique(keys, return_inverse=True)
    there = np.zeros(size, bool)
    there[keys] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[keys]


def gram_places(texts: list[str], n: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams of the texts (rows of code points), and for each n-gram in order: its text, its place in that list."""
    lower, letter = _letters()
    flat = np.frombuffer("".join([f"\n{t}\n" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts)))
    is_letter = letter[flat]
    keep = is_letter.copy()
    keep[:-1] |= is_letter[1:]  # the border before a word
    keep[1:] |= is_letter[:-1]  # the border after a word
    codes = np.where(is_letter, lower[flat], 0)[keep]
    owner, word = owner[keep], is_letter[keep]
    small, coded = _places(codes, 0x110000)
    size, m = max(2, len(small)), len(codes) - n + 1
    if m <= 0:
        return np.zeros((0, n), np.uint32), *(np.zeros(0, np.int64) for _ in range(2))
    key, ok, border = np.zeros(m, np.int64), owner[:m] == owner[n - 1 :], np.zeros(m, np.int64)
    for p in range(n):
        key = key * size + coded[p : p + m]
        if 0 < p < n - 1:
            border += ~word[p : p + m]  # a border inside: the n-gram would join two words
    ok &= border == 0
    key, owner = key[ok], owner[:m][ok]
    grams, place = _places(key, size**n)
    columns = []
    for _ in range(n):
        columns.append(small[grams % size])
        grams = grams // size
    return np.stack(columns[::-1], axis=1), owner, place


def bundles(owner: np.ndarray, place: np.ndarray, vectors: np.ndarray, texts: int) -> np.ndarray:
    """For each text the sum of the vectors of its n-grams."""
    g = len(vectors)
    if texts * g <= max(4_000_000, 4 * len(place)):
        return np.bincount(owner * g + place, minlength=texts * g).reshape(texts, g).astype(np.float32) @ vectors
    cells, counts = np.unique(owner * g + place, return_counts=True)
    begin = np.searchsorted(cells, np.arange(texts + 1) * g)
    out = np.zeros((texts, vectors.shape[1]), np.float32)
    for i in np.flatnonzero(np.diff(begin)):
        span = slice(begin[i], begin[i + 1])
        out[i] = counts[span].astype(np.float32) @ vectors[cells[span] % g]
    return out


def _parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size < PART_CHARS):
            size += len(texts[high])
            high += 1
        yield low, texts[low:high]
        low = high


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, n: int = GRAM, seed: int = 7) -> dict[str, np.ndarray]:
    """Prototype of each language: the exact integer bundle of all its training texts.

    Sums are made per task, then per language and vector cell in Spark; what reaches the driver has the
    size languages x ``dim``. Rows with a null text or language teach nothing.
    """
    small_batches(docs.sparkSession)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for low, part in _parts(texts):
                grams, owner, place = gram_places(part, n)
                if not len(grams):
                    continue
                vectors = gram_vectors(grams, dim, seed).astype(np.float64)
                own, which = np.unique(langs[low : low + len(part)].astype(str), return_inverse=True)
                weight = np.bincount(which[owner] * len(grams) + place, minlength=len(own) * len(grams)).reshape(len(own), -1)
                for lang, got in zip(own.tolist(), np.rint(weight.astype(np.float64) @ vectors).astype(np.int64)):
                    sums[lang] = sums.get(lang, 0) + got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "cells"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    cells = rows.mapInArrow(bundle, "lang string, cells array<bigint>").select("lang", F.posexplode("cells").alias("at", "x"))
    out: dict[str, np.ndarray] = {}
    for row in cells.groupBy("lang", "at").agg(F.sum("x").alias("x")).toLocalIterator():
        out.setdefault(row["lang"], np.zeros(dim))[row["at"]] = row["x"]
    return dict(sorted(out.items()))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None, n: int = GRAM, seed: int = 7) -> DataFrame:
    """One row per document: ``doc_id``, the columns of ``keep``, ``lang_pred``, ``score``.

    ``score`` is the cosine with the chosen prototype, 0 where negative. A text that is null or has no
    letter is ``und`` with score 0; ties go to the language first by name; with no prototypes all are
    ``und``. Repeated rows give repeated rows. One narrow pass; the prototypes are a few kilobytes each.
    """
    small_batches(docs.sparkSession)
    names = sorted(prototypes)
    table = np.stack([prototypes[x] / max(1e-12, float(np.linalg.norm(prototypes[x]))) for x in names]).astype(np.float32) if names else None
    extra = {f"keep_{k}": c for k, c in enumerate((keep or {}).values())}

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).fill_null("").to_pylist()
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            for low, part in _parts(texts) if names else ():
                grams, owner, place = gram_places(part, n)
                if not len(grams):
                    continue
                wholes = bundles(owner, place, gram_vectors(grams, table.shape[1], seed).astype(np.float32), len(part))
                size = np.linalg.norm(wholes, axis=1)
                cosine = wholes @ table.T / np.maximum(size, 1e-12)[:, None]
                with_letters = np.bincount(owner, minlength=len(part)) > 0
                top = np.argmax(cosine, axis=1)
                best[low : low + len(part)] = np.where(with_letters, top, -1)
                score[low : low + len(part)] = np.where(with_letters, np.clip(cosine[np.arange(len(part)), top], 0, 1), 0)
            langs = pa.array([names[k] if k >= 0 else "und" for k in best], pa.string())
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, langs, pa.array(score)], [*batch.schema.names[:-1], "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(k) for k, c in extra.items()], F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(classify, f"{kinds}, lang_pred string, score double").withColumnsRenamed(dict(zip(extra, keep or {})))
