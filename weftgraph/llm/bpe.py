"""Byte-level BPE by rank-synchronous merging of ragged numpy arrays.

A batch of pre-tokens lies in one flat symbol array with the number of its pre-token beside each
symbol. A round looks up the rank of every neighbouring pair, takes the lowest rank of each
pre-token with one segmented minimum, and applies that pair everywhere in its pre-token at once.
Rounds go on until no pre-token has a pair with a rank; finished pre-tokens leave the arrays.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import regex

from .common import KEPT
from .word_memo import WordMemo

# The split pattern of the public byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NEVER = np.int32(2**31 - 1)
#: Pre-tokens with more symbols than this are merged one by one, rank after rank.
LONG = 256
#: From here on a code point's class may differ between Unicode versions; the library splits such texts.
WIDE = 0x530


def _printable_bytes() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary file."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class ByteBPE(WordMemo):
    """Vocabulary, merge table and memo of one ``tokenizers`` JSON file of byte-level BPE.

    ``counts(texts)`` and ``ids(texts)`` agree with ``encode_batch(texts, add_special_tokens=False)``;
    strings of special tokens inside texts become those tokens, as is that library's default.
    """

    def __init__(self, path: str, memo: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        super().__init__({t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}, memo)
        self.path = path
        chars = _printable_bytes()
        self.of_byte = np.array([vocab[c] for c in chars], np.int32)
        self.back = {c: b for b, c in enumerate(chars)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.uint64)
        right = np.array([vocab[b] for _, b in merges], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self._index(left << np.uint64(32) | right)
        self.pattern = regex.compile(SPLIT)
        self._library = None

    # -- pair lookup: an open-addressed hash table in two numpy arrays ---------------------------

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _index(self, keys: np.ndarray) -> None:
        self.bits = max(10, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        size = 1 << self.bits
        self.keys = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(size, NEVER, np.int32)
        rest, at, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(rest):
            free = self.ranks[at] == NEVER
            first = np.unique(np.where(free, at, -1), return_index=True)[1]
            first = first[free[first]]
            self.keys[at[first]], self.ranks[at[first]] = keys[rest[first]], rest[first]
            left = np.ones(len(rest), bool)
            left[first] = False
            rest, at = rest[left], (at[left] + 1) & (size - 1)
            self.probes += 1

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.ranks[at], NEVER)
        open_ = np.flatnonzero((out == NEVER) & (self.ranks[at] != NEVER))
        for step in range(1, self.probes):
            if not len(open_):
                break
            probe = (at[open_] + step) & (len(self.keys) - 1)
            hit = self.keys[probe] == key[open_]
            out[open_[hit]] = self.ranks[probe[hit]]
            open_ = open_[~hit & (self.ranks[probe] != NEVER)]
        return out

    # -- merging ---------------------------------------------------------------------------------

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Final ids of all pieces, one after another, and how many each piece has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        short = np.flatnonzero(sizes <= LONG)
        counts = np.zeros(len(pieces), np.int64)
        flat = self.of_byte[np.frombuffer(b"".join([pieces[i] for i in short] if len(short) < len(pieces) else pieces), np.uint8)]
        owner = np.repeat(short, sizes[short])
        done_ids, done_owner = [], []
        rank = np.full(len(flat), NEVER, np.int32)
        near = np.flatnonzero(owner[:-1] == owner[1:])
        rank[near] = self._rank(flat[near], flat[near + 1])
        while len(flat):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(flat)])
            lowest = np.minimum.reduceat(rank, starts)
            least = np.repeat(lowest, lengths)
            if (lowest == NEVER).any():
                over = least == NEVER
                done_ids.append(flat[over])
                done_owner.append(owner[over])
                live = ~over
                flat, owner, rank, least = flat[live], owner[live], rank[live], least[live]
                if not len(flat):
                    break
            at = np.flatnonzero(rank == least)
            if len(at) > 1 and ((at[1:] == at[:-1] + 1) & (owner[at[1:]] == owner[at[:-1]])).any():
                # in a run such as "aaa" every second position merges, from its left end
                run = np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])]
                begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            flat[at] = self.made[rank[at]]
            stay = np.ones(len(flat), bool)
            stay[at + 1] = False
            flat, owner, rank = flat[stay], owner[stay], rank[stay]
            # only pairs beside a new symbol have a new rank
            at = at - np.arange(len(at))
            for near in (at, at[at > 0] - 1):
                rank[near] = NEVER
                near = near[near + 1 < len(flat)]
                near = near[owner[near] == owner[near + 1]]
                rank[near] = self._rank(flat[near], flat[near + 1])
        for i in np.flatnonzero(sizes > LONG):
            got = self._merge_long(pieces[i])
            done_ids.append(got)
            done_owner.append(np.full(len(got), i, np.int64))
        if not done_ids:
            return np.zeros(0, np.int32), counts
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(pieces))

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """One long pre-token: a heap of ranks, and for each rank all its places, taken together."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        first = self._rank(ids[:-1], ids[1:])
        places: dict[int, list[int]] = {}
        order = np.argsort(first, kind="stable")
        for i in order[: int((first != NEVER).sum())].tolist():
            places.setdefault(int(first[i]), []).append(i)
        heap = sorted(places)
        sym, nxt, prv = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        memo: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in memo:
                memo[a, b] = int(self._rank(np.array([a]), np.array([b]))[0])
            return memo[a, b]

        while heap:
            r = heappop(heap)
            made = int(self.made[r])
            for i in sorted(places.pop(r)):
                j = nxt[i]
                if not alive[i] or j >= n or rank(sym[i], sym[j]) != r:
                    continue
                sym[i], alive[j], nxt[i] = made, False, nxt[j]
                if nxt[j] < n:
                    prv[nxt[j]] = i
                for a, b in ((prv[i], i), (i, nxt[i])):
                    if a >= 0 and b < n and (s := rank(sym[a], sym[b])) != NEVER:
                        if s not in places:
                            places[s] = []
                            heappush(heap, s)
                        places[s].append(a)
        return np.array([s for s, a in zip(sym, alive) if a], np.int32)

    # -- texts -----------------------------------------------------------------------------------

    def split(self, text: str) -> list[bytes]:
        """Pre-tokens as bytes."""
        if text.isascii() or max(text) < chr(WIDE):
            bare = text[1:] if text[:1] == " " else text
            if bare.isalpha() and "'" not in bare:
                return [text.encode()]
            if bare[:-1].isalpha() and bare[-1] in ",.;:!?":
                return [text[:-1].encode(), bare[-1].encode()]
            return [x.encode() for x in self.pattern.findall(text)]
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [bytes([self.back[c] for c in x]) for x, _ in self._library.pre_tokenize_str(text)]

    def _learn(self, words: Iterable[str], known: dict, lead: str) -> None:
        """Add words to a memo: ids where it is a memo of ids, else counts. lead: what stands before each word."""
        ids = known is self.ids_first or known is self.ids_next
        new = list(words)
        for low in range(0, len(new), 100_000):
            part = new[low : low + 100_000]
            splits = [self.split(lead + w) for w in part]
            place: dict[bytes, int] = {}
            where = [place.setdefault(x, len(place)) for s in splits for x in s]
            got, counts = self.merge(list(place))
            if ids:
                raw, ends = got.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
                each = [raw[e - c * 4 : e] for e, c in zip(ends, counts.tolist())]
                gather = b"".join
            else:
                each, gather = counts.tolist(), sum
            at = 0
            for w, s in zip(part, splits):
                n = len(s)
                known[w] = each[where[at]] if n == 1 else gather([each[k] for k in where[at : at + n]])
                at += n


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteBPE:
    """One table and memo for each Python worker."""
    return ByteBPE(path)


KEPT.append(vocabulary.cache_clear)
