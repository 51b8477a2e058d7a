"""Edges as packed arrays, a row for many of them, for work that an exchange of single rows would swell.

A row holds some hundred thousand edges as two byte strings; what goes between tasks is a few bytes an edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written

#: Edges in a packed row.
ROW_EDGES = 1 << 19
#: Edges between two colours that a task of :func:`triangles` holds, 8 bytes and up to 16 of filter each.
TASK_EDGES = 3_000_000
#: Edges that lead to two colours, read at a time.
CHUNK_EDGES = 700_000
#: Pairs of neighbours that are looked up at a time.
WEDGES = 1 << 19
#: Colours of a graph that is worth more than one task.
COLOURS, SMALL_EDGES = 6, 100_000


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as their distance from the least, in as few bytes each as the largest distance needs."""
    low = int(values.min()) if len(values) else 0
    above = values.astype(np.int64).view(np.uint64) - np.array(low, np.int64).view(np.uint64)
    width = max(1, (int(above.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + low.to_bytes(8, "little", signed=True) + np.ascontiguousarray(above.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    width, low = blob[0], int.from_bytes(blob[1:9], "little", signed=True)
    out = np.zeros(((len(blob) - 9) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    return (out.view("<u8").ravel() + np.array(low, np.int64).view(np.uint64)).view(np.int64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Numbers that do not fall: the first, then a byte for each step; steps of 255 and more are behind in full."""
    steps = np.diff(values).astype(np.int64).view(np.uint64)
    large = steps >= 255
    head = np.array([values[0], len(values)], "<i8").tobytes()
    return head + np.where(large, 255, steps).astype(np.uint8).tobytes() + pack(steps[large].view(np.int64))


def unpack_sorted(blob: bytes) -> np.ndarray:
    first, n = np.frombuffer(blob, "<i8", 2)
    out = np.r_[first, np.frombuffer(blob, np.uint8, n - 1, 16).astype(np.int64)]
    out[1:][out[1:] == 255] = unpack(blob[15 + n :])
    return np.cumsum(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """Different numbers in order, by sorting; ``np.unique`` keeps a table, which takes many times as long."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Key, begin and end of each run of equal keys."""
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    yield from zip(keys[at].tolist(), at.tolist(), [*at[1:].tolist(), len(keys)])


def pairs(edges: DataFrame) -> DataFrame:
    """``n, a, b``: the edges without direction, self-loops and nulls, packed, smaller end first; written once.

    An edge that is there several times may stay so in different rows."""

    def row(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
        u, v = np.minimum(src, dst), np.maximum(src, dst)
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
        u, v = u[new], v[new]
        return pa.RecordBatch.from_arrays([pa.array([len(u)], pa.int64()), pa.array([pack_sorted(u)], pa.binary()), pa.array([pack(v)], pa.binary())], ["n", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(k).to_numpy() for k in range(2)])
                n += batch.num_rows
            if n >= ROW_EDGES:
                yield row(*(np.concatenate(x) for x in zip(*held)))
                held, n = [], 0
        if n:
            yield row(*(np.concatenate(x) for x in zip(*held)))

    one = edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).where("src <> dst")
    return written(one.mapInArrow(run, "n long, a binary, b binary"), "pairs")


def hubs(packed: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and a place for each: all nodes of twice the root of ``2 total`` neighbours or more, and none of
    fewer than that root, so no more of them than that. A row sends what has its share of the root there."""
    least = (2.0 * total) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u, v = unpack_sorted(a), unpack(b)
                ids, n = np.unique(np.r_[u, v], return_counts=True)
                hit = n >= least * len(u) / total
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(n[hit])], ["id", "n"])

    sent = packed.select("a", "b").mapInArrow(run, "id long, n long")
    found = sent.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    ids, n = (found.column(c).to_numpy() for c in ("id", "n"))
    place = np.empty(len(ids), np.int64)
    place[np.lexsort((ids, n))] = np.arange(1, len(ids) + 1)
    order = np.argsort(ids)
    return ids[order], place[order]


def block_of(i: np.ndarray | int, j: np.ndarray | int, colours: int):
    return np.minimum(i, j) * colours + np.maximum(i, j)


class Closing:
    """Edges between two colours (or within one), to look pairs of nodes up. A table of bytes turns most away."""

    def __init__(self, u: np.ndarray, v: np.ndarray, first: np.ndarray):
        """``first``: whether ``u`` has the first colour; if not, the two change places."""
        u, v = np.where(first, u, v), np.where(first, v, u)
        self.ids = distinct(np.r_[u, v])
        self.n = len(self.ids)
        self.keys = distinct(np.searchsorted(self.ids, u) * self.n + np.searchsorted(self.ids, v))
        self.shift = np.uint64(64 - max(8, (8 * len(self.keys) - 1).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[self.cell(self.keys)] = True

    def cell(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.ids, ids), self.n - 1)
        return at, self.ids[at] == ids

    def found(self, keys: np.ndarray) -> np.ndarray:
        hit = np.flatnonzero(self.table[self.cell(keys)])
        k = keys[hit]
        return hit[self.keys[np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)] == k]

    def triangles(self, x: np.ndarray, y: np.ndarray, first: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``x`` and the two ends of a closing edge, of arcs from ``x`` to ``y``. ``first``: whether ``y`` has the
        first colour; None within one colour."""
        at, known = self.places(y)
        x, at, first = x[known], at[known], None if first is None else first[known]
        starts = distinct(x)
        arcs = np.searchsorted(starts, x) * self.n + at
        a = distinct(arcs if first is None else arcs[first])
        b = a if first is None else distinct(arcs[~first])
        if not len(a) or not len(b):
            return
        ax, ay, bx, by = a // self.n, a % self.n, b // self.n, b % self.n
        low = np.arange(1, len(a) + 1) if first is None else np.searchsorted(bx, ax)
        many = np.searchsorted(bx, ax, "right") - low
        upto = np.cumsum(many)
        begin = 0
        while begin < len(a):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + WEDGES, "right")))
            k, done = many[begin:end], upto[begin - 1] if begin else 0
            size = int(upto[end - 1] - done)
            if size:
                to = np.arange(size) + np.repeat(low[begin:end] - (upto[begin:end] - k - done), k)
                y_of, z_of = ay[begin:end], by[to]
                # within one colour an edge lies with its smaller end first, as a's arcs do
                hit = self.found(np.repeat(y_of * self.n, k) + z_of)
                e = np.searchsorted(upto[begin:end] - done, hit, "right")
                yield starts[ax[begin:end][e]], self.ids[y_of[e]], self.ids[z_of[hit]]
            begin = end


def triangles(edges: DataFrame) -> DataFrame:
    """``a, b, c``: each triangle once.

    Nodes have colours by hash. A task holds the edges between two colours, ``TASK_EDGES`` at most on average, and
    reads, a chunk of nodes at a time, the arcs that lead to these colours: two arcs of a node whose ends share an edge
    are a triangle. Pairs of arcs are made where they are looked up and go nowhere; an edge goes to a task for
    each colour and one more, so what is exchanged grows with the root of the edges. An arc leads to the larger id,
    or to a hub from what is none; a hub has arcs to larger hubs alone, so no node starts many pairs.
    """
    spark = edges.sparkSession
    packed = pairs(edges)
    total = packed.agg(F.sum("n")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], "a bigint, b bigint, c bigint")
    hub, place = hubs(packed, total)
    colours = max(int(np.ceil((2.0 * total / TASK_EDGES) ** 0.5)), COLOURS if total > SMALL_EDGES else 1)
    chunks = int(-(-2 * total // (colours * CHUNK_EDGES)))

    def colour(ids: np.ndarray) -> np.ndarray:
        return (mixed(ids) % np.uint64(colours)).astype(np.int64)

    def rank(ids: np.ndarray) -> np.ndarray:
        if not len(hub):
            return np.zeros(len(ids), np.int64)
        at = np.minimum(np.searchsorted(hub, ids), len(hub) - 1)
        return np.where(hub[at] == ids, place[at], 0)

    def rows(blocks: list[int], chunk: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        a, b, n = pack_sorted(x), pack(y), len(blocks)
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array([a] * n, pa.binary()), pa.array([b] * n, pa.binary())], ["block", "chunk", "a", "b"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u, v = unpack_sorted(a), unpack(b)
                turn = rank(u) > rank(v)
                x, y = np.where(turn, v, u), np.where(turn, u, v)
                block = block_of(colour(x), colour(y), colours)
                order = np.lexsort((x, block))
                for k, i, j in runs(block[order]):
                    yield rows([k], -1, x[order[i:j]], y[order[i:j]])
                # ids that follow each other share a chunk, so steps between them are small
                part = colour(y) * chunks + ((mixed(x >> 8) >> np.uint64(32)) % np.uint64(chunks)).astype(np.int64)
                order = np.lexsort((x, part))
                for k, i, j in runs(part[order]):
                    c, chunk = divmod(k, chunks)
                    yield rows([int(block_of(c, o, colours)) for o in range(colours)], chunk, x[order[i:j]], y[order[i:j]])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, closing = None, [], None

        def end() -> Iterator[pa.RecordBatch]:
            nonlocal closing
            if at is None:
                return
            x, y = (np.concatenate(p) for p in zip(*held))
            held.clear()
            i, j = divmod(at[0], colours)
            if at[1] < 0:
                closing = Closing(x, y, x < y if i == j else colour(x) == i)
            elif closing is not None:
                for t in closing.triangles(x, y, None if i == j else colour(y) == i):
                    t = np.sort(np.stack(t), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in t], ["a", "b", "c"])

        for batch in batches:
            for block, chunk, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if at != (block, chunk):
                    yield from end()
                    if at is None or at[0] != block:
                        closing = None
                    at = (block, chunk)
                held.append((unpack_sorted(a.as_py()), unpack(b.as_py())))
        yield from end()

    tasks = min(4 * colours * (colours + 1) // 2, 20_000) if colours > 1 else 1
    dealt = packed.select("a", "b").mapInArrow(deal, "block int, chunk int, a binary, b binary")
    return dealt.repartition(tasks, "block").sortWithinPartitions("block", "chunk").mapInArrow(search, "a long, b long, c long")
