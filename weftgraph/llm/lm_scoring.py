"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs are quantised to levels, ``level = 1 + floor(log_base(count))``, and each
n-gram enters the filter once for every level up to its own. A count is read back by asking for level 1, 2,
... until one is missing, and stands for the middle of that level's range. The filter is cut into segments by
hash; a reduce task fills each from exact counts over the whole corpus and reads it back for the n-grams of
each chunk of documents, so no worker holds the whole filter.

The probability of a word after another is the pair's count, smoothed towards the word's own probability as
if ``kappa`` more words had been drawn from it (Dirichlet smoothing); the word's own is add-one.

The filter grows with the corpus at ``bits_per_entry`` and holds every n-gram, so ``coverage`` is always 1; what
grows is the number of segments, not their size. Base scores never use the filter: they take exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ROWS, Layout, block_rows, by_bucket, in_chunks, packed_counts, summed, unpacked_counts
from .common import distinct, mix, ranks, small_batches, text_bytes
from .words import coded, parts, word_hashes

END, START = np.uint64(0x7F4A7C15F39CC060), np.uint64(0x106689D45497FDB5)
FLUSH = 3_000_000
LEVEL_STEP = 0x9E3779B97F4A7C15


#: Texts whose words are told apart at a time; a word that many of them have is hashed once.
PART = 1_500_000


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left) * np.uint64(3) + right)


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's words in lower case and its end, as places in a list of hashes; that list, which begins with the
    end and the start mark; where each text begins and ends."""
    at, words, ends = coded([t.lower() for t in texts])
    out = np.insert(at.astype(np.int32) + np.int32(2), ends[1:], np.int32(0))
    return out, np.r_[END, START, word_hashes(words)], ends + np.arange(len(ends))


def before(tokens: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """The token before each token; ``start`` before a text's first."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[ends[:-1]] = start
    return out


def pairs_of(tokens: np.ndarray, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it."""
    return pair_hashes(hashes[before(tokens, ends, 1)], hashes[tokens])


@dataclass(frozen=True)
class LogFrequencyFilter:
    bits: np.ndarray  # all segments, packed
    begin: np.ndarray  # first bit of each bucket's segment
    size: np.ndarray  # bits of each bucket's segment
    bucket_bits: int
    base: float
    probes: int

    @staticmethod
    def places(hashes: np.ndarray, level: int, probes: int) -> Iterator[np.ndarray]:
        one = mix(hashes + np.uint64(level * LEVEL_STEP % (1 << 64)))
        two = mix(one) | np.uint64(1)
        for k in range(probes):
            yield one + np.uint64(k) * two

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Level of each n-gram, 0 where it is not in the filter; never too low, now and then too high."""
        out = np.zeros(len(hashes), np.int64)
        bucket = (hashes >> np.uint64(64 - self.bucket_bits)).astype(np.int64)
        live = np.flatnonzero(self.size[bucket] > 0)
        level = 0
        while len(live) and level < 200:
            level += 1
            one = mix(hashes[live] + np.uint64(level * LEVEL_STEP % (1 << 64)))
            two = mix(one) | np.uint64(1)
            for _ in range(self.probes):
                own = bucket[live]
                at = self.begin[own] + (one % self.size[own].astype(np.uint64)).astype(np.int64)
                there = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                live, two = live[there], two[there]
                one = one[there] + two
            out[live] = level
        return out

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Estimated counts: the middle of the level's range, 0 for none."""
        level = self.levels(hashes)
        return np.where(level == 0, 0.0, (self.base ** (level - 1) + self.base**level - 1) / 2)


def segment(hashes: np.ndarray, counts: np.ndarray, base: float, probes: int, bits_per_entry: float, most: int) -> tuple[bytes, int, int]:
    """One bucket's bits, their number, and how many n-grams they hold: all, or the most frequent that fit."""
    level = 1 + np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64)
    if int(level.sum()) * bits_per_entry > most:
        order = np.lexsort((hashes, -counts))
        order = order[: np.searchsorted(np.cumsum(level[order]) * bits_per_entry, most, "right")]
        hashes, level = hashes[order], level[order]
    n = min(most, max(64, int(level.sum() * bits_per_entry))) // 8 * 8
    flags = np.zeros(n, np.uint8)
    for j in range(1, int(level.max(initial=0)) + 1):
        for place in LogFrequencyFilter.places(hashes[level >= j], j, probes):
            flags[(place % np.uint64(n)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes(), n, len(hashes)


def fit(docs: DataFrame, layout: Layout, *, text_col: str) -> tuple[int, int]:
    """How many tokens, and how many different ones, the training texts have."""
    bits = layout.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            if held[0]:
                h, c = summed(*held)
                rows = [(0, b, h[s].astype("<u8").tobytes(), packed_counts(c[s])) for b, s in by_bucket(h, bits)]
            held[0].clear()
            held[1].clear()
            yield from block_rows(rows).to_batches()

        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary()).fill_null(b"").to_pylist()
            for _, part in parts(texts, PART):
                tokens, hashes, _ = sequences(part)
                counts = np.bincount(tokens, minlength=len(hashes))
                held[0].append(hashes[counts > 0])
                held[1].append(counts[counts > 0])
                if sum(map(len, held[0])) > FLUSH:
                    yield from flush()
        yield from flush()

    def add(table: pa.Table) -> pa.Table:
        blobs, extra = (table.column(c).to_pylist() for c in ("a", "b"))
        h, c = summed([np.frombuffer(x, "<u8") for x in blobs], [unpacked_counts(e, len(x) // 8) for e, x in zip(extra, blobs)])
        return pa.table([[int(c.sum())], [len(h)]], ["n_tokens", "n_types"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(count, ROWS).groupBy("bucket").applyInArrow(add, "n_tokens long, n_types long")
    row = found.agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_types").alias("n_types")).first()
    return row["n_tokens"] or 0, row["n_types"] or 0


def score(docs: DataFrame, training, *, id_col: str = "doc_id", text_col: str = "text", base: float = 1.5, probes: int = 4, bits_per_entry: float = 6.0, kappa: float = 60.0) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, coverage``.

    ``training`` is a boolean column: which documents the model learns from; the others are ``held_out``.
    Tokens are words in lower case (A-Z) and one end. ``base_score`` sums log10((c+1)/(N+V+1)) with exact
    counts c; ``score`` is the filter model's log10 probability. A null or empty text is its end alone;
    with no training documents every probability is 1; repeated rows give repeated rows; an empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("train"), F.col(text_col).cast("string").alias("text"))
    layout = Layout.of(docs, text_bytes(narrow))
    n_train, n_types = fit(narrow.where("train"), layout, text_col="text")
    dealt = in_chunks(narrow, layout, F.col("doc_id"), F.octet_length("text"))
    bits, total = layout.bits, float(n_train + n_types + 1)

    def read(table: pa.Table) -> list[bytes]:
        return table.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()

    def ask(table: pa.Table) -> pa.Table:
        """The chunk's different tokens (the start mark too) and pairs, and how often its training texts have each."""
        texts, train = read(table), table.column("train").to_numpy()
        held: tuple[tuple[list, list], ...] = (([], []), ([], []))
        for low, part in parts(texts, PART):
            tokens, hashes, ends = sequences(part)
            own = train[low : low + len(part)]
            weight = np.repeat(own, np.diff(ends))
            counts = np.bincount(tokens, weight, minlength=len(hashes)).astype(np.int64)
            counts[1] = own.sum()
            held[0][0].append(hashes)
            held[0][1].append(counts)
            held[1][0].append(pairs_of(tokens, hashes, ends))
            held[1][1].append(weight.astype(np.int32))
        chunk = table.column("chunk")[0].as_py()
        (words, n_words), (pairs, n_pairs) = (summed(h, c) for h, c in held)
        own, rows = dict(by_bucket(words, bits)), []
        others = dict(by_bucket(pairs, bits))
        for b in sorted(own.keys() | others.keys()):
            s, t = own.get(b, slice(0, 0)), others.get(b, slice(0, 0))
            counts = np.r_[n_words[s], n_pairs[t]]
            size = (s.stop - s.start).to_bytes(8, "little")
            rows.append((chunk, b, size + np.r_[words[s], pairs[t]].astype("<u8").tobytes(), packed_counts(counts)))
        return block_rows(rows)

    def answer(table: pa.Table) -> pa.Table:
        """The bucket's segment of the filter is filled, then asked for each chunk's words and pairs. Words get exact counts, too."""
        chunks, blobs, extra = (table.column(c).to_pylist() for c in ("chunk", "a", "b"))
        bucket = table.column("bucket")[0].as_py()
        n_words = [int.from_bytes(x[:8], "little") for x in blobs]
        lists = [np.frombuffer(x, "<u8", offset=8) for x in blobs]
        counts = [unpacked_counts(e, len(h)) for e, h in zip(extra, lists)]
        words, c_words = summed([h[:n] for h, n in zip(lists, n_words)], [c[:n] for c, n in zip(counts, n_words)])
        pairs, c_pairs = summed([h[n:] for h, n in zip(lists, n_words)], [c[n:] for c, n in zip(counts, n_words)])
        all_h, all_c = np.r_[words, pairs], np.r_[c_words, c_pairs]
        there = all_c > 0
        flags, n, _ = segment(all_h[there], all_c[there], base, probes, bits_per_entry, 1 << 62)
        begin, size = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        size[bucket] = n if there.any() else 0
        levels = LogFrequencyFilter(np.frombuffer(flags, np.uint8), begin, size, bits, base, probes).levels(all_h).astype(np.uint8)
        rows = []
        for k, h, m in zip(chunks, lists, n_words):
            at, of = np.searchsorted(words, h[:m]), np.searchsorted(pairs, h[m:])
            exact = packed_counts(c_words[at])
            rows.append((k, bucket, m.to_bytes(8, "little") + levels[at].tobytes() + exact, levels[len(words) + of].tobytes()))
        return block_rows(rows)

    def judge(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = read(table)
        order = np.argsort(answers.column("bucket").to_numpy())
        a, b = answers.column("a").to_pylist(), answers.column("b").to_pylist()
        n_words = [int.from_bytes(x[:8], "little") for x in a]
        known = np.concatenate([unpacked_counts(a[k][8 + n_words[k] :], n_words[k]) for k in order])
        # the middle of a level's range, 0 for none
        level = np.arange(256.0)
        middle = np.where(level == 0, 0.0, (base ** (level - 1) + base**level - 1) / 2)
        own = middle[np.concatenate([np.frombuffer(a[k], np.uint8, n_words[k], 8) for k in order])]
        of_pair = np.frombuffer(b"".join([b[k] for k in order]), np.uint8)
        # answers are in the order of the hashes, as buckets are their top bits
        read_parts, pairs = [], []
        for _, part in parts(texts, PART):
            tokens, hashes, ends = sequences(part)
            read_parts.append((tokens, hashes, ends))
            pairs.append(pairs_of(tokens, hashes, ends))
        words = distinct(np.concatenate([h for _, h, _ in read_parts]))
        pair_at, low = ranks(np.concatenate(pairs)), 0
        del pairs
        n_tokens, n_known, base_score, scores = [], [], [], []
        log_known = np.log10(known + 1.0)
        for tokens, hashes, ends in read_parts:
            at = np.searchsorted(words, hashes)
            c_left = own[at][before(tokens, ends, 1)]
            c_pair = np.minimum(middle[of_pair[pair_at[low : low + len(tokens)]]], c_left)
            low += len(tokens)
            p = (c_pair + (kappa * (own[at] + 1) / total)[tokens]) / (c_left + kappa)
            starts = ends[:-1]
            n_tokens.append(np.diff(ends))
            n_known.append(np.add.reduceat((known[at] > 0)[tokens].astype(np.int64), starts))
            base_score.append(np.add.reduceat(log_known[at][tokens], starts) - np.diff(ends) * np.log10(total))
            scores.append(np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts))
        n = len(texts)
        train = table.column("train").to_numpy()
        columns = [table.column("doc_id").combine_chunks(), pa.array(~train), *(pa.array(np.concatenate(c).astype(np.int64)) for c in (n_tokens, n_known)), pa.array(np.full(n, n_train, np.int64)), *(pa.array(np.concatenate(c)) for c in (base_score, scores)), pa.array(np.ones(n))]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "coverage"])

    chunked = dealt.groupBy("chunk")
    answers = chunked.applyInArrow(ask, ROWS).groupBy("bucket").applyInArrow(answer, ROWS)
    return chunked.cogroup(answers.groupBy("chunk")).applyInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, coverage double")
