"""Tokens of whole texts through a memo of words.

A text is cut at single spaces into words on which the token borders of a vocabulary always fall. Different
words of many texts are found by Arrow's dictionary encoding and looked up once; new ones go to the
vocabulary's own ``_learn``. The memo is of bounded size and is emptied when full.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space that no non-space character follows.
DOUBLE = re.compile(r" (?!\S)")


class WordMemo:
    def __init__(self, special: dict[str, int], memo: int):
        self.special, self.memo_size = special, memo
        self.cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.counts_first: dict[str, int] = {}
        self.counts_next: dict[str, int] = {}
        self.ids_first: dict[str, bytes] = {}
        self.ids_next: dict[str, bytes] = {}

    def _learn(self, words: Iterable[str], known: dict, lead: str) -> None:
        """Add words to a memo: ids where it is a memo of ids, else counts. lead: what stands before each word."""
        raise NotImplementedError

    @staticmethod
    def words(text: str) -> list[str]:
        """Parts of a text whose borders are always borders of pre-tokens: cut at each space that a
        non-space character follows. All but the first stand for themselves with that space."""
        parts = text.split(" ")
        if DOUBLE.search(text):
            whole = parts[:1]
            for p in parts[1:]:
                if not p or p[0].isspace():
                    whole[-1] += " " + p
                else:
                    whole.append(p)
            parts = whole
        return parts

    def _parts(self, text: str | None) -> tuple[list[list[str]], list[int]]:
        """Words between special tokens, and the special tokens between them."""
        if not text:
            return [], []
        if self.cut is None or not (found := list(self.cut.finditer(text))):
            return [self.words(text)], []
        ends = [0, *(x for m in found for x in m.span()), len(text)]
        return [self.words(text[a:b]) if b > a else [] for a, b in zip(ends[::2], ends[1::2])], [self.special[m[0]] for m in found]

    def _known(self, first: list[str], rest: list[str], ids: bool) -> list:
        """What the memo holds for words that begin a text and for words after a space, new ones merged."""
        out: list = []
        for words, lead, known in ((first, "", self.ids_first if ids else self.counts_first), (rest, " ", self.ids_next if ids else self.counts_next)):
            found = list(map(known.get, words))
            if None in found:
                if len(known) > self.memo_size:
                    known.clear()
                self._learn({w for w, x in zip(words, found) if x is None}, known, lead)
                found = [known[w] if x is None else x for w, x in zip(words, found)]
            out += found
        return out

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], list[str], np.ndarray]:
        """Words of texts as places in a list of different words: ends of texts, places, words that begin a
        text, other words, and whether a text has a space that no word follows."""
        parts = pc.split_pattern(texts, " ")
        ends = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        rest = coded.dictionary.to_pylist()
        odd = np.fromiter((not w or w[0].isspace() for w in rest), bool, len(rest))
        inner = odd[at]
        inner[ends[:-1]] = False
        bad = np.add.reduceat(inner, ends[:-1]) > 0
        heads, at[ends[:-1]] = np.unique(at[ends[:-1]], return_inverse=True)
        first = [rest[i] for i in heads.tolist()]
        later = np.ones(len(at), bool)
        later[ends[:-1]] = False
        at[later] += len(first)
        return ends, at, first, rest, bad

    def _slow(self, text: str, ids: bool) -> list:
        parts, special = self._parts(text)
        out: list = []
        for k, words in enumerate(parts):
            out += self._known(words[:1], words[1:], ids)
            if k < len(special):
                out.append(special[k].to_bytes(4, "little") if ids else 1)
        return out

    def _batches(self, texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        """Slices of some megabytes, so that lists of words stay small."""
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + 8_000_000)))
            yield low, texts.slice(low, high - low)
            low = high

    def _sorted_out(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows that the plain way takes, and those that hold special tokens."""
        special = np.zeros(len(part), bool)
        for token in self.special:
            special |= pc.match_substring(part, token).to_numpy(zero_copy_only=False)
        return np.flatnonzero(~special), np.flatnonzero(special)

    def counts(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        """Number of tokens of each text; null counts as empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out = np.zeros(len(texts), np.int64)
        for low, part in self._batches(texts):
            plain, slow = self._sorted_out(part)
            if len(plain):
                ends, at, first, rest, bad = self._plain(part.take(pa.array(plain)))
                known = self._known(first, ["" if not w or w[0].isspace() else w for w in rest], False)
                out[low + plain] = np.add.reduceat(np.array(known, np.int64)[at], ends[:-1])
                slow = [*slow.tolist(), *plain[bad].tolist()]
            for i in slow:
                out[low + i] = sum(self._slow(part[i].as_py(), False))
            out[low + np.flatnonzero(pc.equal(pc.binary_length(part), 0).to_numpy(zero_copy_only=False))] = 0
        return out

    def ids(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        for low, part in self._batches(texts):
            plain, slow = self._sorted_out(part)
            found: dict[int, np.ndarray] = {}
            if len(plain):
                ends, at, first, rest, bad = self._plain(part.take(pa.array(plain)))
                known = self._known(first, ["" if not w or w[0].isspace() else w for w in rest], True)
                size = np.fromiter(map(len, known), np.int64, len(known)) // 4
                begin = np.cumsum(size) - size
                pool = np.frombuffer(b"".join(known), "<u4")
                n = size[at]
                upto = np.r_[0, np.cumsum(n)]
                flat = pool[np.arange(upto[-1]) + np.repeat(begin[at] - upto[:-1], n)]
                for k, i in enumerate(plain.tolist()):
                    found[i] = flat[upto[ends[k]] : upto[ends[k + 1]]]
                slow = [*slow.tolist(), *plain[bad].tolist()]
            for i in slow:
                found[i] = np.frombuffer(b"".join(self._slow(part[i].as_py(), True)), "<u4")
            empty = pc.equal(pc.binary_length(part), 0).to_numpy(zero_copy_only=False)
            for i in range(len(part)):
                yield np.zeros(0, "<u4") if empty[i] else found[i]
