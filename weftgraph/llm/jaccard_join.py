"""Exact Jaccard join of word n-gram sets by an R-tree over count vectors.

1. Equal texts are one node. Each node's set of hashed shingles is sorted by (document frequency, hash); two
   sets that reach the threshold share one of the first ``n - ceil(t n) + 1`` in that order. Shingles that one
   node alone has are left out, so a text without near copies sends no key. Frequencies come from an exchange
   of fingerprint lists (see :mod:`.blocks`); any frequencies give a right order, so collisions are harmless.
2. Nodes meet at shared keys, where an R-tree over their count vectors bounds overlaps (see :mod:`.count_tree`).
   Keys that many nodes have are split by salt. The first pass proposes for each node one partner: the most
   typical node that may reach the threshold. Proposals are verified on the sets, links give components.
3. The second pass goes over keys at which different components still meet, all of their nodes against each
   other in small tiles, and proposes every pair of different components that the bounds allow: after the trees' one
   that of a count vector so fine that it is nearly the overlap itself. A pair is looked at where its least common
   key is, and nowhere else. So no link between different components is missed, and a group of near copies is never
   expanded into all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..algo.components import connected_components
from ..plans.lineage import cut, written
from .blocks import ROWS, Layout, block_rows, by_bucket, in_chunks, middle, packed_counts, summed, unpacked_counts
from .common import let_go, small_batches, text_bytes
from .count_tree import CountForest, count_vector, near_in_size, needed, pair_bound
from .words import hashed, parts, windows

#: Nodes at a key that choose their partners together.
GROUP = 4096
#: Nodes at a key in a tile of the second pass; a task holds two tiles.
TILE = 512


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of each text, sorted within it, and where each text's begin and end."""
    held, sizes = [], []
    for _, part in parts(texts):
        words, ends = hashed([t.lower() for t in part])
        got, at = windows(words, ends, n)
        owner = np.searchsorted(ends, at, "right") - 1
        lengths = np.diff(ends)
        for i in np.flatnonzero((lengths > 0) & (lengths < n)):
            whole, _ = windows(words[ends[i] : ends[i + 1]], np.array([0, lengths[i]]), int(lengths[i]))
            got, owner = np.append(got, whole), np.append(owner, i)
        order = np.lexsort((got, owner))
        got, owner = got[order], owner[order]
        first = np.r_[True, (got[1:] != got[:-1]) | (owner[1:] != owner[:-1])] if len(got) else np.zeros(0, bool)
        held.append(got[first])
        sizes.append(np.bincount(owner[first], minlength=len(part)))
    if not held:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(held), np.r_[0, np.cumsum(np.concatenate(sizes))]


def _nodes(table: pa.Table, wanted: set[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Ids and texts of the nodes that this chunk stands for, each once."""
    found: dict[bytes, bytes] = {}
    texts = table.column("text").cast(pa.large_binary()).to_pylist()
    for tid, text in zip(table.column("tid").to_pylist(), texts):
        if tid in wanted and tid not in found:
            found[tid] = text
    return list(found), list(found.values())


NODE = "tid binary, n long, keys array<long>, splits array<int>, vector binary, typical double, shingles binary, fine binary"
#: Groups of the fine count vector, kept as the list of its elements' groups: two bytes for an element.
FINE = 1 << 16
PAIR = "a binary, b binary, bound double"


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each key's rows begin in it."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(max(0, len(order) - 1), bool)
    for k in keys:
        change |= k[order][1:] != k[order][:-1]
    return order, np.r_[0, np.flatnonzero(change) + 1, len(order)] if len(order) else np.zeros(1, np.int64)


def _proposals(tids: list[bytes], found: list[tuple[int, int, float]]) -> pa.Table:
    a, b, x = zip(*found) if found else ((), (), ())
    return pa.table([pa.array([tids[i] for i in a], pa.binary()), pa.array([tids[i] for i in b], pa.binary()), pa.array(x, pa.float64())], ["a", "b", "bound"])


def _estimate(bound, a, b):
    return bound / np.maximum(1, a + b - bound)


def text_id(text_col: str) -> Column:
    """The text's 128-bit hash; a null text has that of the empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, with_keys: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, n_links``.

    Words are cut at ASCII white space and lowered (A-Z). Two documents are linked when 100 x intersection >=
    ``percent`` x union of their sets of ``n``-word shingles; a text of fewer words is one shingle; one
    without words, or null, has none and is linked with nothing. ``component_id`` is the smallest doc_id that
    links reach; ``n_links`` counts the verified links of a document's text to other texts that were needed
    to find it. Repeated rows give repeated rows; null ids are never a ``component_id`` unless a whole
    component has none; an empty table gives an empty one. ``with_keys`` adds ``tid``, which :func:`text_id` gives
    for the text, and ``component``, a key that all documents of a component share, with ids or without.
    """
    spark = docs.sparkSession
    if percent <= 50:
        raise ValueError("percent must be above 50")
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("tid", text_id("text"))
    layout = Layout.of(docs, text_bytes(narrow))
    bits = layout.bits
    dealt = in_chunks(narrow, layout, F.col("doc_id"), F.octet_length("text"))
    first = cut(narrow.select("tid", "doc_id", F.octet_length("text").alias("size")).groupBy("tid").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size")))
    chosen = first.select(F.pmod(F.xxhash64("doc_id", "size"), F.lit(layout.chunks)).cast("int").alias("chunk"), F.lit(-1).alias("bucket"), F.col("tid").alias("a"), F.lit(b"").alias("b"))

    def ask(table: pa.Table, wanted: pa.Table) -> pa.Table:
        if not table.num_rows:
            return block_rows([])
        let_go()
        _, texts = _nodes(table, set(wanted.column("a").to_pylist()))
        hashes, counts = np.unique(shingles(texts, n)[0], return_counts=True)
        chunk, out = table.column("chunk")[0].as_py(), []
        for b, s in by_bucket(hashes, bits):
            prints, c = summed([middle(hashes[s], bits)], [counts[s]])
            out.append((chunk, b, prints.astype("<u4").tobytes(), packed_counts(c)))
        return block_rows(out)

    def answer(table: pa.Table) -> pa.Table:
        chunks, blobs, extra = (table.column(c).to_pylist() for c in ("chunk", "a", "b"))
        sizes = [len(x) // 4 for x in blobs]
        prints = np.frombuffer(b"".join(blobs), "<u4")
        counts = np.concatenate([unpacked_counts(e, k) for e, k in zip(extra, sizes)])
        _, where = np.unique(prints, return_inverse=True)
        total = np.bincount(where, counts.astype(np.float64)).astype(np.int64)[where]
        bucket, at, out = table.column("bucket")[0].as_py(), 0, []
        for c, k in zip(chunks, sizes):
            if (total[at : at + k] > 1).any():
                out.append((c, bucket, packed_counts(total[at : at + k]), b""))
            at += k
        return block_rows(out)

    def describe(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        let_go()
        if table.num_rows:
            buckets, blobs = answers.column("bucket").to_pylist(), answers.column("a").to_pylist()
            tids, texts = _nodes(table, {a for b, a in zip(buckets, blobs) if b < 0})
            hashes, ends = shingles(texts, n)
            known, where = np.unique(hashes, return_inverse=True)
            of = {b: a for b, a in zip(buckets, blobs) if b >= 0}
            common = np.ones(len(known), np.int64)
            for b, s in by_bucket(known, bits):
                if b in of:
                    prints, place = np.unique(middle(known[s], bits), return_inverse=True)
                    common[s] = unpacked_counts(of[b], len(prints))[place]
            common = common[where]
            for i, tid in enumerate(tids):
                own, df = hashes[ends[i] : ends[i + 1]], common[ends[i] : ends[i + 1]]
                size = len(own)
                prefix = np.lexsort((own, df))[: size - (-(-percent * size // 100)) + 1] if size else np.zeros(0, np.int64)
                prefix = prefix[df[prefix] > 1]
                if len(prefix):
                    splits = -(-df[prefix] // GROUP)
                    rows.append((tid, size, own[prefix].view(np.int64).tolist(), splits.tolist(), count_vector(own), float(np.log2(df).mean()), own.astype("<u8").tobytes(), np.sort(own.astype("<u2")).tobytes()))
                else:
                    rows.append((tid, size, *[None] * 6))
        columns = list(zip(*rows)) if rows else [[] for _ in range(8)]
        kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.float64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["tid", "n", "keys", "splits", "vector", "typical", "shingles", "fine"])

    chunked = dealt.groupBy("chunk")
    answers = chunked.cogroup(chosen.groupBy("chunk")).applyInArrow(ask, ROWS).groupBy("bucket").applyInArrow(answer, ROWS)
    nodes = written(chunked.cogroup(answers.unionByName(chosen).groupBy("chunk")).applyInArrow(describe, NODE), "jaccard-nodes")

    keyed = nodes.where("keys is not null").select("tid", "n", "vector", "typical", F.explode(F.arrays_zip("keys", "splits")).alias("k"))
    keyed = keyed.select("tid", "n", "vector", "typical", F.col("k.keys").alias("key"), F.col("k.splits").alias("splits"))
    salted = keyed.withColumn("salt", F.when(F.col("splits") > 1, F.pmod(F.xxhash64("tid"), "splits")).otherwise(0).cast("int"))
    task = F.pmod(F.xxhash64("key", "salt"), F.lit(layout.chunks)).cast("int")

    def stars(table: pa.Table) -> pa.Table:
        keys, salts, sizes, typical = (table.column(c).to_numpy() for c in ("key", "salt", "n", "typical"))
        tids, vectors = table.column("tid").to_pylist(), table.column("vector").to_pylist()
        rank = np.argsort(np.argsort(np.array(tids, object), kind="stable"))
        order, bounds = _groups([keys, salts])
        widths, found = np.diff(bounds), []
        two = bounds[:-1][widths == 2]
        if len(two):
            a, b = order[two], order[two + 1]
            ok = near_in_size(sizes[a], sizes[b], percent)
            a, b = a[ok], b[ok]
            bound = np.array([pair_bound(vectors[i], sizes[i], vectors[j], sizes[j]) for i, j in zip(a, b)], np.int64)
            hit = bound >= needed(sizes[a], sizes[b], percent)
            less = np.where(typical[a] != typical[b], typical[a] > typical[b], rank[a] < rank[b])
            for x, y, o in zip(np.where(less, b, a)[hit].tolist(), np.where(less, a, b)[hit].tolist(), _estimate(bound, sizes[a], sizes[b])[hit].tolist()):
                found.append((x, y, o))
        for g in np.flatnonzero(widths > 2):
            rows = order[bounds[g] : bounds[g + 1]]
            rows = rows[np.lexsort((rank[rows], -typical[rows]))]
            own = sizes[rows]
            tree, free = CountForest([vectors[i] for i in rows], own), np.ones(len(rows), bool)
            for i in range(len(rows)):
                if free[i]:
                    free[i] = False
                    near, bound = tree.search(i, percent)
                    take = free[near]
                    near, bound = near[take], bound[take]
                    free[near] = False
                    found += zip(rows[near].tolist(), [int(rows[i])] * len(near), _estimate(bound, own[near], own[i]).tolist())
        return _proposals(tids, found)

    proposals = salted.withColumn("task", task).groupBy("task").applyInArrow(stars, PAIR)
    best = proposals.groupBy("a").agg(F.max_by("b", F.struct("bound", "b")).alias("b"))
    sets = nodes.where("keys is not null").select("tid", "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        def check(batches):
            for batch in batches:
                a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                keep = []
                for x, y in zip(a, b):
                    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        left = pairs.join(sets.select(F.col("tid").alias("a"), F.col("shingles").alias("sa")), "a")
        both = left.join(sets.select(F.col("tid").alias("b"), F.col("shingles").alias("sb")), "b")
        return cut(both.select("a", "b", "sa", "sb").mapInArrow(check, "a binary, b binary"))

    links = verified(best)
    groups = connected_components(links, "a", "b")

    placed = salted.join(groups.select(F.col("id").alias("tid"), "component"), "tid", "left").withColumn("component", F.coalesce("component", "tid"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts")).where("lo <> hi").select("key", "parts")
    tiled = placed.drop("salt").join(mixed, "key").withColumn("part", F.pmod(F.xxhash64("tid", "key"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiled = tiled.select("tid", "n", "vector", "component", "key", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    tiled = tiled.join(nodes.select("tid", "fine", "keys"), "tid")
    task = F.pmod(F.xxhash64("key", "low", "high"), F.lit(layout.chunks)).cast("int")

    def bridges(table: pa.Table) -> pa.Table:
        keys, lows, highs, part, sizes = (table.column(c).to_numpy() for c in ("key", "low", "high", "part", "n"))
        tids, vectors, fine = (table.column(c).to_pylist() for c in ("tid", "vector", "fine"))
        prefixes = [frozenset(x) for x in table.column("keys").to_pylist()]
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        dense = np.zeros(FINE, np.int32)

        def groups_of(i: int) -> tuple[np.ndarray, np.ndarray]:
            """A node's fine groups and their counts, worked out once however many keys it has here."""
            if tids[i] not in known:
                cells, counts = np.unique(np.frombuffer(fine[i], "<u2"), return_counts=True)
                known[tids[i]] = cells, counts.astype(np.int32)
            return known[tids[i]]

        def may_link(i: int, others: list[int]) -> list[int]:
            """Those of the others for which the fine count vectors, too, allow the threshold."""
            cells, counts = groups_of(i)
            dense[cells] = counts
            left = []
            for j in others:
                own, n_own = groups_of(j)
                if np.minimum(dense[own], n_own).sum() >= needed(sizes[i], sizes[j], percent):
                    left.append(j)
            dense[cells] = 0
            return left

        def is_here(i: int, j: int) -> bool:
            """Whether this is the place for a pair: its least common key, in the tile of the two nodes' parts."""
            return (part[i] != part[j]) == (lows[i] != highs[i]) and min(prefixes[i] & prefixes[j]) == keys[i]

        component = np.unique(np.array(table.column("component").to_pylist(), object), return_inverse=True)[1]
        rank = np.argsort(np.argsort(np.array(tids, object), kind="stable"))
        order, bounds = _groups([keys, lows, highs])
        pairs: list[tuple[int, int, float]] = []
        widths = np.diff(bounds)
        two = bounds[:-1][widths == 2]
        if len(two):
            a, b = order[two], order[two + 1]
            ok = near_in_size(sizes[a], sizes[b], percent) & (component[a] != component[b])
            a, b = a[ok], b[ok]
            bound = np.array([pair_bound(vectors[i], sizes[i], vectors[j], sizes[j]) for i, j in zip(a, b)], np.int64)
            hit = bound >= needed(sizes[a], sizes[b], percent)
            for x, y in zip(a[hit].tolist(), b[hit].tolist()):
                if is_here(x, y) and may_link(x, [y]):
                    pairs.append((x, y, 0.0) if rank[x] < rank[y] else (y, x, 0.0))
        for g in np.flatnonzero(widths > 2):
            rows = order[bounds[g] : bounds[g + 1]]
            own = component[rows]
            kinds, size_of = np.unique(own, return_counts=True)
            if len(kinds) < 2:
                continue
            tree = CountForest([vectors[i] for i in rows], sizes[rows])
            for i in np.flatnonzero(own != kinds[size_of.argmax()]):  # a pair has at least one outside the largest component
                near, _ = tree.search(i, percent)
                largest = kinds[size_of.argmax()]
                # of two nodes outside the largest component the first looks for the second
                todo = near[(own[near] != own[i]) & ((near > i) | (own[near] == largest))]
                x = int(rows[i])
                for y in may_link(x, [y for y in rows[todo].tolist() if is_here(x, y)]):
                    pairs.append((x, y, 0.0) if rank[x] < rank[y] else (y, x, 0.0))
        return _proposals(tids, pairs)

    more = tiled.withColumn("task", task).groupBy("task").applyInArrow(bridges, PAIR).select("a", "b")
    links = cut(links.unionByName(verified(more)))
    groups = connected_components(links, "a", "b")

    ids = first.join(groups.select(F.col("id").alias("tid"), "component"), "tid", "left").withColumn("component", F.coalesce("component", "tid"))
    least = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("n_links"))
    facts = nodes.select("tid", F.col("n").alias("n_shingles")).join(ids.select("tid", "component"), "tid").join(least, "component").join(degree, "tid", "left")
    out = narrow.select("doc_id", "tid").join(facts.select("tid", "n_shingles", "component", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "tid")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "n_links", *(["tid", "component"] if with_keys else []))
