"""Graph algorithms with the nodes' state in arrays and the edges in shards.

The state is a few numbers a node, held by the driver and sent to the tasks of each round; edges are written once,
packed, a shard for each range of nodes, and never all in one process. A round is one job without an exchange. What a
shard holds of its own it settles by itself, so chains within a range take one round. The driver holds about 100
bytes a node; ``NODES`` is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from . import local, sequential
from .packed import mixed, pack, pack_sorted, runs, unpack, unpack_sorted

NODES = 5_000_000
#: Edges of a shard, each way.
SHARD_EDGES = 1_500_000
#: Edges and nodes of a graph, or edges of one of communities, that the driver moves by itself, 300 bytes and more each.
DRIVER_EDGES = 250_000


def sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(values[order], at) if len(at) else values[:0]


class Shards:
    """``edges``: src, dst and maybe weight (whole numbers, added up over equal pairs). A shard has the edges into its
    nodes; ``both``: also those out of them, turned."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, both: bool):
        self.spark = spark = nodes.sparkSession
        self.ids = ids = np.sort(nodes.select("id").distinct().toArrow().column(0).to_numpy())
        self.n = n = len(ids)
        if n > NODES:
            raise ValueError(f"the graph has more than {NODES} nodes, whose state one process holds")
        total = edges.count() * (2 if both else 1)
        self.width = width = max(1, -(-n // max(2 * spark.sparkContext.defaultParallelism, -(-total // SHARD_EDGES))))
        sent = spark.sparkContext.broadcast(ids)
        weight = F.col("weight").cast("bigint") if "weight" in edges.columns else F.lit(1).cast("bigint")

        def merge(low: int, other: np.ndarray, own: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, w = sums((own - low) * n + other, w)
            return keys // n, keys % n, w

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def out() -> Iterator[pa.RecordBatch]:
                src, dst, w = (np.concatenate(x) for x in zip(*held))
                a, b = np.searchsorted(sent.value, src), np.searchsorted(sent.value, dst)
                if both:
                    a, b, w = np.r_[a, b], np.r_[b, a], np.r_[w, w]
                order = np.argsort(b // width, kind="stable")
                a, b, w = a[order], b[order], w[order]
                for k, i, j in runs(b // width):
                    own, other, many = merge(k * width, a[i:j], b[i:j], w[i:j])
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in (pack_sorted(own), pack(other), pack(many)))], ["shard", "own", "other", "weight"])

            for batch in batches:
                if batch.num_rows:
                    held.append([c.to_numpy() for c in batch.columns])
                    size += batch.num_rows
                if size >= 1 << 19:
                    yield from out()
                    held, size = [], 0
            if size:
                yield from out()

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, []

            def out() -> pa.RecordBatch:
                own, other, w = merge(0, *(np.concatenate([x[k] for x in held]) for k in (1, 0, 2)))
                return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([x], pa.binary()) for x in (pack_sorted(own), pack(other), pack(w)))], ["shard", "own", "other", "weight"])

            for batch in batches:
                for k, *blobs in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                    if k != at and held:
                        yield out()
                        held.clear()
                    at = k
                    own, other, w = (b.as_py() for b in blobs)
                    held.append((unpack_sorted(own), unpack(other), unpack(w)))
            if held:
                yield out()

        kind = "shard int, own binary, other binary, weight binary"
        rows = edges.select("src", "dst", weight).mapInArrow(deal, kind)
        tasks = max(1, -(-n // width))
        self.rows = written(rows.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(gather, kind), "shards")

    def each(self, work: Callable, schema: str, *state) -> DataFrame:
        """``work(low, high, own, other, weight, *state)`` for each shard gives columns; own ends count from ``low``."""
        sent, width, n = self.spark.sparkContext.broadcast(state), self.width, self.n
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, *blobs in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                    own, other, w = (b.as_py() for b in blobs)
                    out = work(k * width, min(n, (k + 1) * width), unpack_sorted(own), unpack(other), unpack(w), *sent.value)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)

        return self.rows.mapInArrow(run, schema)

    def round(self, work: Callable, value: np.ndarray, *state) -> tuple[np.ndarray, int]:
        """``value`` with the places and numbers that ``work`` gives put in, and how many these are."""
        found = self.each(work, "at long, value long", value, *state).toArrow()
        at = found.column(0).to_numpy()
        value = value.copy()
        value[at] = found.column(1).to_numpy()
        return value, len(at)

    def frame(self, name: str, value: np.ndarray) -> DataFrame:
        return self.spark.createDataFrame(pa.table({"id": self.ids, name: value}), f"id bigint, {name} bigint")


def layers(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, bool]:
    """``id, layer`` of the nodes that no cycle holds back, and whether these are all."""
    g = Shards(nodes, edges, both=False)

    def work(low, high, own, other, w, layer):
        size = high - low
        inner = (other >= low) & (other < high)
        level = np.zeros(size, np.int64)
        np.maximum.at(level, own[~inner], layer[other[~inner]] + 1)
        waits = np.bincount(own[inner | (layer[other] < 0)], minlength=size)
        a, b = other[inner] - low, own[inner]
        order, begin = local.rows_of(a, size)
        front, known = np.flatnonzero(waits == 0), np.zeros(size, bool)
        while len(front):
            known[front] = True
            e = local.edges_at(order, begin, front)
            np.maximum.at(level, b[e], level[a[e]] + 1)
            near, less = np.unique(b[e], return_counts=True)
            waits[near] -= less
            front = near[waits[near] == 0]
        new = np.flatnonzero(known & (layer[low:high] < 0))
        return new + low, level[new]

    reached = g.each(lambda low, high, own, other, w: (np.unique(own) + low,), "at long").toArrow().column(0).to_numpy()
    layer = np.zeros(g.n, np.int64)
    layer[reached] = -1
    moved = len(reached)
    while moved:
        layer, moved = g.round(work, layer)
    return g.frame("layer", layer).where("layer >= 0"), bool((layer >= 0).all())


def cores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, core``, as :func:`.iterative.core_numbers`: from its degree down, a node takes the largest h for which
    h neighbours are at h or more, until nothing changes."""
    g = Shards(nodes, edges.where("src <> dst"), both=True)

    def degree(low, high, own, other, w, value):
        return np.arange(low, high), np.bincount(own, minlength=high - low)

    def work(low, high, own, other, w, value):
        mine, theirs = value[low:high], value[other]
        short = np.bincount(own[theirs >= mine[own]], minlength=high - low) < mine
        keep = short[own]
        own, theirs = own[keep], np.minimum(theirs[keep], mine[own[keep]])
        order = np.lexsort((-theirs, own))
        own, theirs = own[order], theirs[order]
        begin = np.searchsorted(own, own)
        h = np.zeros(high - low, np.int64)
        np.maximum.at(h, own, np.minimum(theirs, np.arange(len(own)) - begin + 1))
        hit = np.flatnonzero(short)
        return hit + low, h[hit]

    value, _ = g.round(degree, np.zeros(g.n, np.int64))
    moved = 1
    while moved:
        value, moved = g.round(work, value)
    return g.frame("core", value)


def _moves(low, high, own, other, w, place, total, k, twice, resolution, turn):
    """Best community of each node whose turn it is; and, as place -1, the weight within communities."""
    n = len(place)
    inside = int(w[place[other] == place[own + low]].sum())
    mine = (mixed(np.arange(low, high)) + np.uint64(turn)) % np.uint64(2) == 0
    keep = mine[own] & (other != own + low)
    keys, links = sums(own[keep] * n + place[other[keep]], w[keep].astype(float))
    who, c = keys // n, keys % n
    home, degree = place[who + low], k[who + low]
    gain = links - resolution * (total[c] - np.where(c == home, degree, 0)) * degree / twice
    own_k, own_home = k[low:high], place[low:high]
    stay = -resolution * (total[own_home] - own_k) * own_k / twice
    stay[who[c == home]] = gain[c == home]
    order = np.lexsort((c, -gain, who))
    first = order[np.r_[True, who[order][1:] != who[order][:-1]]] if len(order) else order
    go = first[gain[first] > stay[who[first]] + 1e-12]
    return np.r_[-1, who[go] + low], np.r_[inside, c[go]]


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``id, label``: communities by moving nodes while that raises modularity, then the same on the graph of
    communities. Half of the nodes, by hash and in turn, move at a time, from what the round before left, so two do not
    change places for ever; the best state of all rounds is kept, the first being that of single nodes. A graph of
    communities that is small goes to :func:`.sequential.louvain`. Labels are the smallest member."""
    g = Shards(nodes, edges, both=True)
    ids, member = g.ids, np.arange(g.n)
    while True:
        at_k = g.each(lambda low, high, own, other, w: (np.arange(low, high), np.bincount(own, w, high - low).astype(np.int64)), "at long, k long").toArrow()
        k = np.zeros(g.n, np.int64)
        k[at_k.column(0).to_numpy()] = at_k.column(1).to_numpy()
        twice = float(k.sum())
        if not twice:
            break
        place = best_place = np.arange(g.n)
        best, idle, turn = -np.inf, 0, 0
        while idle < 6:
            total = np.bincount(place, k, g.n)
            found = g.each(_moves, "at long, value long", place, total, k, twice, resolution, turn).toArrow()
            at, to = (c.to_numpy() for c in found.columns)
            score = to[at < 0].sum() / twice - resolution * ((total / twice) ** 2).sum()
            idle = 0 if score > best + 1e-4 else idle + 1
            if score > best:
                best, best_place = score, place
            place = place.copy()
            place[at[at >= 0]] = to[at >= 0]
            turn += 1
        names, place = np.unique(best_place, return_inverse=True)
        member = place[member]
        if len(names) == g.n:
            break

        def merged(low, high, own, other, w, place, many):
            a, b = place[own + low], place[other]
            keys, total = sums(a * many + b, w)
            return keys // many, keys % many, total

        # each edge came both ways, and one within a community as two
        arcs = written(g.each(merged, "src long, dst long, weight long", place, len(names)).groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("src <= dst"), "communities")
        if arcs.count() <= DRIVER_EDGES:
            rows = arcs.toArrow()
            a, b, w = (c.to_numpy() for c in rows.columns)
            found = sequential.louvain(list(range(len(names))), list(zip(a.tolist(), b.tolist(), np.where(a == b, w / 2, w).tolist())), resolution)
            member = np.array([found[c] for c in range(len(names))])[member]
            break
        once = arcs.select("src", "dst", F.when(F.col("src") == F.col("dst"), F.col("weight") / 2).otherwise(F.col("weight")).cast("bigint").alias("weight"))
        g = Shards(nodes.sparkSession.range(len(names)), once, both=True)
    _, first = np.unique(member, return_index=True)
    least = np.zeros(member.max(initial=0) + 1, np.int64)
    least[member[first]] = ids[first]
    return nodes.sparkSession.createDataFrame(pa.table({"id": ids, "label": least[member]}), "id bigint, label bigint")
