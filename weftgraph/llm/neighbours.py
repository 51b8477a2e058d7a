"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are grown on a bounded sample; every vector is then routed to one leaf of each tree. A node splits by
the direction between two centres, started from a random pair, at the median. A query walks all trees from
one priority queue, the nearest border first, and opens leaves until they hold a given share of the sample;
all vectors in those leaves are ranked by their exact distance. The share is found by calibration: on some
rows of the sample, the smallest with which the leaves opened hold ``target`` of the true neighbours, which
are found by a scan of all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written

#: Vectors, in bytes, that a task should hold.
GROUP_BYTES = 64_000_000


@dataclass
class Tree:
    normals: np.ndarray  # one row for each inner node
    limits: np.ndarray
    below: np.ndarray  # child on the low side; -1 - leaf for a leaf
    above: np.ndarray
    mass: np.ndarray  # sample rows in each leaf

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        node = np.zeros(len(x), np.int64) if len(self.limits) else np.full(len(x), -1)
        while (live := np.flatnonzero(node >= 0)).size:
            at = node[live]
            up = np.einsum("ij,ij->i", x[live], self.normals[at]) > self.limits[at]
            node[live] = np.where(up, self.above[at], self.below[at])
        return -1 - node


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    normals, limits, below, above, mass = [], [], [], [], []

    def node(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            some = x[rows[rng.integers(0, len(rows), min(256, len(rows)))]]
            a, b = some[0], some[-1]
            for _ in range(4):
                side = some @ (a - b) > ((a * a).sum() - (b * b).sum()) / 2
                if side.all() or not side.any():
                    break
                a, b = some[side].mean(0), some[~side].mean(0)
            w = a - b
            if np.linalg.norm(w) == 0:
                w = rng.standard_normal(x.shape[1])
            w = w / np.linalg.norm(w)
            at = x[rows] @ w
            limit = float(np.median(at))
            up = at > limit
            if up.any() and not up.all():
                k = len(limits)
                normals.append(w)
                limits.append(limit)
                below.append(0)
                above.append(0)
                below[k] = node(rows[~up])
                above[k] = node(rows[up])
                return k
        mass.append(len(rows))
        return -len(mass)

    node(np.arange(len(x)))
    return Tree(np.array(normals).reshape(-1, x.shape[1]), np.array(limits), np.array(below, np.int64), np.array(above, np.int64), np.array(mass, np.int64))


def walk(trees: list[Tree], q: np.ndarray) -> Iterator[tuple[int, int]]:
    """(tree, leaf), nearest border first over all trees."""
    sides = [t.normals @ q - t.limits for t in trees]
    heap = [(0.0, k, 0 if len(t.limits) else -1) for k, t in enumerate(trees)]
    while heap:
        far, k, node = heappop(heap)
        tree, side = trees[k], sides[k]
        while node >= 0:
            s = side[node]
            near, other = (tree.above[node], tree.below[node]) if s > 0 else (tree.below[node], tree.above[node])
            heappush(heap, (max(far, abs(s)), k, int(other)))
            node = int(near)
        yield k, -1 - node


def opened(trees: list[Tree], q: np.ndarray, mass: float) -> list[tuple[int, int]]:
    out, total = [], 0
    for k, leaf in walk(trees, q):
        out.append((k, leaf))
        total += trees[k].mass[leaf]
        if total >= mass:
            break
    return out


def distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision, from differences."""
    out = np.empty((len(queries), len(rows)))
    for i, q in enumerate(queries):
        d = rows - q
        out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)


def _classes(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """Different usable vectors (as doubles), each with its ``k`` + 1 smallest ids, which are all that a
    result can need. Ids are cut down in tasks before they meet, so a vector that many rows share is light."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or v is None or not v or None in v:
                    continue
                x = np.array(v, "<f8") + 0.0
                if not np.isfinite(x).all() or not x.any():
                    continue
                ids = held.setdefault(x.tobytes(), [])
                ids.append(i)
                if len(ids) > 4 * k + 40:
                    held[x.tobytes()] = sorted(set(ids))[: k + 1]
            if len(held) > 20_000:
                yield _class_rows(held, k)
                held = {}
        yield _class_rows(held, k)

    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    found = own.mapInArrow(gather, "vector binary, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return found.groupBy("vector").agg(ids.alias("ids"))


def _class_rows(held: dict[bytes, list[int]], k: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(set(x))[: k + 1] for x in held.values()], pa.list_(pa.int64()))], ["vector", "ids"])


def search(vectors: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, trees: int = 12, leaf_rows: int = 64, sample_rows: int = 16_384, most_sample_rows: int = 131_072, calibration: int = 96, target: float = 0.97, seed: int = 11) -> DataFrame:
    """Each query's ``k`` nearest other rows: ``query_id, rank, vec_id, score``.

    ``is_query`` is a boolean column. Nearest by Euclidean distance, ties to the smaller id. Vectors that are
    null, empty, zero, or hold a null or non-finite component take no part, nor do those whose length is not
    the commonest in the sample. Rows with equal vectors share one place in the index; a row is never its own
    neighbour, nor is another row with its id. An id on several different vectors asks with each of them, and is
    found at the nearest. With ``k`` or fewer candidates all are returned. An empty table gives an empty one.

    The forest is fitted to one row in 64, at least ``sample_rows`` and at most ``most_sample_rows``; every row is
    indexed. A leaf of more than ``GROUP_BYTES`` is cut into pieces by a hash, each of which a query asks: every
    piece gives its ``k`` + 1 nearest, so nothing is lost and no task holds much more than that.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    queries = vectors.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    classes = written(_classes(vectors, id_col, vector_col, k), "vector-classes")
    n_classes = classes.count()
    wanted = min(most_sample_rows, max(sample_rows, n_classes // 64))
    # twice the rows wanted by a hash, so that what is sorted is bounded too
    some = classes.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(min(1.0, 2 * wanted / max(1, n_classes)) * (1 << 30)))
    sample = some.orderBy(F.xxhash64("vector"), "vector").limit(wanted).select("vector", "ids").collect()
    if not sample:
        return spark.createDataFrame([], schema)
    lengths = np.array([len(r["vector"]) for r in sample])
    size = int(np.bincount(lengths).argmax())
    x = _matrix([bytes(r["vector"]) for r in sample if len(r["vector"]) == size])
    rng = np.random.default_rng(seed)
    forest = [grow(x, leaf_rows, rng) for _ in range(trees)]
    usable = classes.where(F.octet_length("vector") == size)

    probes = x[:calibration]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in probes]
        for batch in batches:
            blobs = batch.column(0).to_pylist()
            if blobs:
                d = distances(probes, _matrix(blobs))
                for q in range(len(probes)):
                    near = np.argpartition(d[q], min(k, len(blobs) - 1))[: k + 1]
                    best[q] = sorted(best[q] + [(float(d[q, i]), blobs[i]) for i in near])[: k + 1]
        rows = [(q, d, v) for q, found in enumerate(best) for d, v in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.float64(), pa.binary()))], ["q", "d", "v"])

    def least(t: pa.Table) -> pa.Table:
        return t.sort_by([("d", "ascending")]).slice(1, k)  # the first is the probe itself

    truth = usable.select("vector").mapInArrow(scan, "q int, d double, v binary").groupBy("q").applyInArrow(least, "q int, d double, v binary").collect()
    by_probe: dict[int, list[bytes]] = {}
    for r in truth:
        by_probe.setdefault(r["q"], []).append(bytes(r["v"]))
    costs: list[float] = []
    for q, near in by_probe.items():
        y, order, total = _matrix(near), {}, 0
        leaves = [t.leaf(y) for t in forest]
        for cell in walk(forest, probes[q]):
            order[cell] = total
            total += forest[cell[0]].mass[cell[1]]
        costs += [min(order[i, int(own[j])] for i, own in enumerate(leaves)) for j in range(len(near))]
    mass = float(np.quantile(costs, target, method="higher")) + 1 if costs else float(x.shape[0])
    mass = max(mass, 4.0 * k)
    sent = spark.sparkContext.broadcast((forest, mass))
    width = max(len(t.mass) for t in forest)
    least_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = -(-n_classes * size // (width * GROUP_BYTES)) or 1
    by_bytes = -(-trees * n_classes * size // GROUP_BYTES)
    tasks = max(least_tasks, trees * width // 16, by_bytes)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch.column(0).to_pylist())
                piece = np.array([xxhash.xxh3_64_intdigest(v) % pieces for v in batch.column(0).to_pylist()], np.int64) if pieces > 1 else 0
                for i, t in enumerate(sent.value[0]):
                    cells = (i * width + t.leaf(y)) * pieces + piece
                    yield pa.RecordBatch.from_arrays([pa.array(cells % tasks, pa.int32()), pa.array(cells, pa.int64()), batch.column(0), batch.column(1)], ["task", "cell", "vector", "ids"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or v is None or len(v) * 8 != size or None in v:
                    continue
                q = np.array(v, "<f8") + 0.0
                if not np.isfinite(q).all() or not q.any():
                    continue
                cells = np.array([a * width + b for a, b in opened(sent.value[0], q, sent.value[1])], np.int64)
                cells = (cells[:, None] * pieces + np.arange(pieces)).ravel()
                order = np.argsort(cells % tasks, kind="stable")
                cells = cells[order]
                own, starts = np.unique(cells % tasks, return_index=True)
                lists = np.split(cells, starts[1:])
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([c.tolist() for c in lists], pa.list_(pa.int64())), pa.array([i] * n, pa.int64()), pa.array([q.tobytes()] * n, pa.binary())], ["task", "cells", "query_id", "q"])

    def rank(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            vectors_, ids = _matrix(rows.column("vector").to_pylist()), rows.column("ids").to_pylist()
            cells = rows.column("cell").to_numpy()
            order = np.argsort(cells, kind="stable")
            keys = cells[order]
            for i, q, own in zip(asked.column("query_id").to_pylist(), asked.column("q").to_pylist(), asked.column("cells").to_pylist()):
                spans = [order[np.searchsorted(keys, c) : np.searchsorted(keys, c, "right")] for c in own]
                near = np.concatenate(spans)
                if len(near):
                    d = distances(np.frombuffer(q, "<f8")[None], vectors_[near])[0]
                    # a vector counts once for each leaf that it was met in; k + 1 different ones are enough
                    seen: set[tuple] = set()
                    for b in np.argsort(d, kind="stable").tolist():
                        key = tuple(ids[near[b]])
                        if key not in seen:
                            seen.add(key)
                            out.append((i, float(d[b]), ids[near[b]]))
                            if len(seen) > k and d[b] > out[-2][1]:
                                break
        return pa.table([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.float64(), pa.list_(pa.int64())))], ["query_id", "d", "ids"])

    def finish(table: pa.Table) -> pa.Table:
        q = table.column("query_id")[0].as_py()
        found: dict[int, float] = {}
        for d, ids in zip(table.column("d").to_pylist(), table.column("ids").to_pylist()):
            for j in ids:
                if j != q and d < found.get(j, np.inf):
                    found[j] = d
        best = sorted((d, j) for j, d in found.items())[:k]
        return pa.table([pa.array([q] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([j for _, j in best], pa.int64()), pa.array([d for d, _ in best], pa.float64())], ["query_id", "rank", "vec_id", "score"])

    routed = usable.mapInArrow(route, "task int, cell long, vector binary, ids array<long>")
    asked = queries.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(ask, "task int, cells array<long>, query_id long, q binary")
    if by_bytes > least_tasks:
        routed, asked = routed.repartition(by_bytes, "task"), asked.repartition(by_bytes, "task")
    ranked = routed.groupBy("task").cogroup(asked.groupBy("task")).applyInArrow(rank, "query_id long, d double, ids array<long>")
    return ranked.groupBy("query_id").applyInArrow(finish, schema)
