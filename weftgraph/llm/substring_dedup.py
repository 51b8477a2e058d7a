"""Removal of passages that an earlier document has already, by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id. It is indexed in blocks by hash: a block holds,
for its share of all ``n``-word phrases, where each phrase starts first: the smallest id and the first word there.
A document is parsed greedily against the index: a factor begins at the first phrase that the reference has, copies
from that place, and is extended word by word as long as the phrase one word on has its place one word on in the same
source. So a factor is (source, place, length), of ``n`` words at least. At its border the phrases that begin in its
last ``n - 1`` words and reach across are looked up as well; the first that the reference has begins a factor of its
own, which overlaps. So the union of the factors is what the phrases of the reference cover.

The index is reached in two exchanges of hash lists (see :mod:`.blocks`). The first carries fingerprints and
finds phrases that more than one chunk has; the second carries full hashes and places of those alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import ROWS, Layout, block_rows, by_bucket, in_chunks, joined, middle, packed_ints, unpacked_ints
from .common import distinct, let_go, small_batches, text_bytes
from .words import hashed, parts, spread, windows

_EMPTY = b""


def _texts(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts of a chunk, their ids, and which of them have an id."""
    ids = table.column("doc_id")
    known = ids.is_valid().to_numpy()
    return table.column("text").cast(pa.large_binary()).fill_null(_EMPTY).to_pylist(), ids.fill_null(0).to_numpy(), known


def phrases(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of every phrase of ``n`` words; the last two in 32 bits."""
    hs, owner, first = [], [], []
    for low, part in parts(texts):
        h, ends = hashed(part)
        got, at = windows(h, ends, n)
        who = np.searchsorted(ends, at, "right") - 1
        hs.append(got)
        owner.append((who + low).astype(np.int32))
        first.append((at - ends[who]).astype(np.int32))
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(hs), np.concatenate(owner), np.concatenate(first)


def _with_id(hashes: np.ndarray, owner: np.ndarray, first: np.ndarray, ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, id and first word of the phrases whose text has an id."""
    if known.all():
        return hashes, ids[owner], first
    ok = known[owner]
    return hashes[ok], ids[owner[ok]], first[ok]


def _in_order(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places in the order of hash, id and place; most hashes are there once, so only equal ones are sorted further."""
    order = np.argsort(hashes)
    h = hashes[order]
    same = h[1:] == h[:-1]
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    sub = order[tied]
    order[tied] = sub[np.lexsort((places[sub], docs[sub], hashes[sub]))]
    return order


def _least(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes in order, the smallest id of each and its first place there, whether more than one id has it,
    and which of them each hash is."""
    order = _in_order(hashes, docs, places)
    h = hashes[order]
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    h, last = h[starts], order[np.r_[starts[1:], len(order)][: len(starts)] - 1]
    which = np.empty(len(order), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    starts = order[starts]
    return h, docs[starts], places[starts], docs[last] != docs[starts], which


def factors(source: np.ndarray, place: np.ndarray, there: np.ndarray, n: int) -> list[tuple[int, int, int, int]]:
    """Greedy parse of one document: (first word, words, source, place in it) of each factor.

    ``there`` says which phrases the reference has, ``source`` and ``place`` where. The next factor begins behind the
    last, or before that at the first phrase across its border that the reference has.
    """
    at = np.flatnonzero(there)
    if not len(at):
        return []
    goes_on = (at[1:] == at[:-1] + 1) & (source[at[1:]] == source[at[:-1]]) & (place[at[1:]] == place[at[:-1]] + 1)
    begin = np.flatnonzero(np.r_[True, ~goes_on])
    size = np.diff(np.r_[begin, len(at)]) + n - 1
    return list(zip(at[begin].tolist(), size.tolist(), source[at[begin]].tolist(), place[at[begin]].tolist()))


def merged(found: list[tuple]) -> list[tuple[int, int]]:
    """Union of overlapping or touching factors, as spans."""
    out: list[list[int]] = []
    for a, n, *_ in found:
        if out and a <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n - out[-1][0])
        else:
            out.append([a, n])
    return [(a, n) for a, n in out]


def _remainder(text: bytes, words: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and the white space after each."""
    out, at, word = [], 0, 0
    for a, n in spans:
        begin = at
        for w in words[word:a]:
            at = text.index(w, at) + len(w)
        stop = text.index(words[a], at)
        out.append(text[begin:stop])
        at = stop
        for w in words[a : a + n]:
            at = text.index(w, at) + len(w)
        word = a + n
        if word < len(words):
            at = text.index(words[word], at)
    out.append(text[at:] if word < len(words) or not spans else b"")
    return b"".join(out)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 13, with_text: bool = True, keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, factors, kept_sha256[, text]`` and the columns of ``keep``.

    Words covered by a window of ``n`` words that also starts in a document with a smaller id are removed;
    windows are those of the input. ``factors`` holds ``start, length, source, source_start`` in words, ``source``
    being the smallest id that has the factor's first window. ``kept_sha256`` is of the kept words joined by one
    space; ``text`` keeps
    the white space between kept words. A null text has no words and stays null; a null id is in nobody's
    reference, and its document is left whole; rows repeated with the same id are no reference for each
    other; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    carried = {f"keep_{k}": c for k, c in enumerate((keep or {}).values())}
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[c.alias(k) for k, c in carried.items()])
    layout = Layout.of(docs, text_bytes(narrow))
    dealt = in_chunks(narrow, layout, F.col("doc_id"), F.octet_length("text"))
    bits = layout.bits

    def ask(table: pa.Table) -> pa.Table:
        let_go()
        texts, _, known = _texts(table)
        hashes, owner, _ = phrases(texts, n)
        hashes = distinct(hashes[known[owner]])
        chunk = table.column("chunk")[0].as_py()
        return block_rows([(chunk, b, distinct(middle(hashes[s], bits)).tobytes(), _EMPTY) for b, s in by_bucket(hashes, bits)])

    def shared(table: pa.Table) -> pa.Table:
        let_go()
        chunks = table.column("chunk").to_pylist()
        blobs = table.column("a").to_pylist()
        prints, _ = joined(blobs, "<u4")
        order = np.argsort(prints)
        same = prints[order[1:]] == prints[order[:-1]]
        flags, out, at = np.empty(len(prints), bool), [], 0
        flags[order] = np.r_[False, same] | np.r_[same, False]
        del order, same
        for c, blob in zip(chunks, blobs):
            k = len(blob) // 4
            if flags[at : at + k].any():
                out.append((c, table.column("bucket")[0].as_py(), np.packbits(flags[at : at + k]).tobytes(), _EMPTY))
            at += k
        return block_rows(out)

    def ask_more(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return block_rows([])
        let_go()
        texts, ids, known = _texts(table)
        hashes, owner, first = phrases(texts, n)
        h, least, place, several, _ = _least(*_with_id(hashes, owner, first, ids, known))
        del hashes, owner, first, texts
        flags = dict(zip(answers.column("bucket").to_pylist(), answers.column("a").to_pylist()))
        chunk, out = table.column("chunk")[0].as_py(), []
        for b, s in by_bucket(h, bits):
            keep = several[s].copy()
            if b in flags:
                prints, where = np.unique(middle(h[s], bits), return_inverse=True)
                keep |= np.unpackbits(np.frombuffer(flags[b], np.uint8), count=len(prints)).astype(bool)[where]
            if keep.any():
                out.append((chunk, b, h[s][keep].astype("<u8").tobytes(), packed_ints(least[s][keep]) + packed_ints(place[s][keep])))
        return block_rows(out)

    def earlier(table: pa.Table) -> pa.Table:
        """For each chunk the phrases that an earlier document of another chunk has, with their first place."""
        let_go()
        chunks, blobs = table.column("chunk").to_pylist(), table.column("a").to_pylist()
        h, came = joined(blobs, "<u8")
        docs_of, places = (np.concatenate(x) for x in zip(*(unpacked_ints(b, len(x) // 8, 2) for x, b in zip(blobs, table.column("b").to_pylist()))))
        order = _in_order(h, docs_of, places)
        group = np.cumsum(np.r_[False, h[order][1:] != h[order][:-1]])
        first = order[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])]
        best = np.empty(len(h), np.int64)
        best[order] = first[group]
        later, out = docs_of[best] < docs_of, []
        bounds = np.searchsorted(came, np.arange(len(chunks) + 1))
        for k, c in enumerate(chunks):
            hit = np.flatnonzero(later[bounds[k] : bounds[k + 1]]) + bounds[k]
            if len(hit):
                out.append((c, table.column("bucket")[0].as_py(), h[hit].tobytes(), packed_ints(docs_of[best[hit]]) + packed_ints(places[best[hit]])))
        return block_rows(out)

    types, names = dict(narrow.dtypes), list(carried)
    kinds = "".join(f"{k} {types[k]}, " for k in carried) + "doc_id long, n_words long, n_removed long, factors array<struct<start: int, length: int, source: long, source_start: int>>, kept_sha256 string" + (", text string" if with_text else "")

    def parse(table: pa.Table, answers: pa.Table) -> pa.Table:
        let_go()
        texts, ids, known = _texts(table)
        hashes, owner, first = phrases(texts, n)
        source, place, flags = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int32), np.zeros(len(hashes), bool)
        ok = slice(None) if known.all() else np.flatnonzero(known[owner])
        h, least, least_place, _, which = _least(*_with_id(hashes, owner, first, ids, known))
        del hashes, first
        if len(h):
            source[ok], place[ok] = least[which], least_place[which]
            flags[ok] = source[ok] < ids[owner[ok]]
            del least, least_place
            blobs = answers.column("a").to_pylist()
            if blobs:
                seen, _ = joined(blobs, "<u8")
                seen_source, seen_place = (np.concatenate(x) for x in zip(*(unpacked_ints(b, len(x) // 8, 2) for x, b in zip(blobs, answers.column("b").to_pylist()))))
                order = np.argsort(seen)
                at = order[np.minimum(np.searchsorted(seen[order], h), len(seen) - 1)]
                hit = np.flatnonzero((seen[at] == h)[which])
                at = at[which[hit]]
                hit = hit if known.all() else ok[hit]
                source[hit], place[hit], flags[hit] = seen_source[at], seen_place[at], True
                del seen, seen_source, seen_place, order, at, hit
            del blobs
        del h, which
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        n_words, n_removed, parsed, digests, kept = [], [], [], [], []
        for i, text in enumerate(texts):
            words = text.split()
            own = slice(bounds[i], bounds[i + 1])
            copies = factors(source[own], place[own], flags[own], n)
            found = merged(copies)
            left = words
            if found:
                gone = np.zeros(len(words), bool)
                for a, k in found:
                    gone[a : a + k] = True
                left = [w for w, g in zip(words, gone.tolist()) if not g]
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            parsed.append([{"start": a, "length": k, "source": d, "source_start": p} for a, k, d, p in copies])
            digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
            if with_text:
                kept.append(_remainder(text, words, found) if found else text)
        columns = [table.column("doc_id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(parsed, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))), pa.array(digests, pa.string())]
        if with_text:
            null = table.column("text").is_null().to_pylist()
            columns.append(pa.array([None if x else k for x, k in zip(null, kept)], pa.binary()).cast(pa.string()))
        columns = [*(table.column(k) for k in names), *columns]
        return pa.table(columns, [*names, "doc_id", "n_words", "n_removed", "factors", "kept_sha256", *(["text"] if with_text else [])])

    chunked = dealt.groupBy("chunk")
    many = chunked.applyInArrow(ask, ROWS).groupBy("bucket").applyInArrow(shared, ROWS)
    dated = chunked.cogroup(many.groupBy("chunk")).applyInArrow(ask_more, ROWS).groupBy("bucket").applyInArrow(earlier, ROWS)
    out = chunked.cogroup(dated.groupBy("chunk")).applyInArrow(parse, kinds)
    return out.withColumnsRenamed(dict(zip(carried, keep or {})))
