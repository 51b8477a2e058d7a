"""Words and word n-grams of many texts as numpy arrays.

Words are runs of bytes other than space and ASCII tab to carriage return, which is what ``bytes.split()``
cuts at; ``bytes.lower()`` lowers A-Z alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .common import mix

#: Text whose words are held as Python objects at a time.
PART_BYTES = 500_000


def parts(texts: list[bytes], size: int = PART_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of about ``size`` bytes, whole texts each."""
    low = 0
    while low < len(texts):
        high, n = low, 0
        while high < len(texts) and (high == low or n < size):
            n += len(texts[high])
            high += 1
        yield low, texts[low:high]
        low = high


def coded(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Every word as its place in a list of different words; that list; where each text's words begin and end."""
    flat: list[bytes] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        flat += t.split()
        ends[i + 1] = len(flat)
    if not flat:
        return np.zeros(0, np.int64), [], ends
    found = pa.array(flat, pa.large_binary()).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist(), ends


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """64-bit hash of each word."""
    one = xxhash.xxh3_64_intdigest
    return np.fromiter((one(w, seed) for w in words), np.uint64, len(words))


def hashed(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, text after text, and where each text's words begin and end."""
    at, words, ends = coded(texts)
    return (word_hashes(words, seed)[at] if len(words) else np.zeros(0, np.uint64)), ends


def windows(hashes: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``n`` words inside a text, and the place of its first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(m, np.uint64(n), np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    left = np.repeat(ends[1:], np.diff(ends))  # where the text of each word ends
    at = np.flatnonzero(np.arange(m) + n <= left[:m])
    return mix(out[at]), at


def owners(ends: np.ndarray) -> np.ndarray:
    """For each word the place of its text."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def spread(flags: np.ndarray, at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words a flagged window of ``n`` words, beginning at ``at``, covers."""
    begin = at[flags]
    steps = np.bincount(begin, minlength=total + 1) - np.bincount(begin + n, minlength=total + 1)
    return np.cumsum(steps[:-1]) > 0
