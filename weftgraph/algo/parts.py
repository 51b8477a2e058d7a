"""Searches from all nodes of a graph, part by part.

A part is a weak component, or some small ones; no search leaves it. Edges are written once, packed, then dealt to tasks
by part, so a task holds the edges of one part and neither the driver nor any task those of the graph. A part with much
to do goes to several tasks, which share its sources. The driver holds about 30 bytes a node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from . import local
from .packed import ROW_EDGES, distinct, mixed, pack, pack_sorted, runs, unpack, unpack_sorted

#: Nodes with edges for a search that has no other form; as many as :data:`PART_EDGES` edges can have.
NODES = 40_000_000
#: Edges of a part that a task holds, with up to 40 bytes each while they are put in order.
PART_EDGES = 20_000_000
#: Nodes of small components that make a part together.
TOGETHER_NODES = 1024
#: Edges that are taken into the components at a time.
MERGED_EDGES = 2_000_000


def arcs(edges: DataFrame) -> DataFrame:
    """``n, a, b``: all edges as they are, packed, by their first ends; written once."""

    def row(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(src, kind="stable")
        return pa.RecordBatch.from_arrays([pa.array([len(src)], pa.int64()), pa.array([pack_sorted(src[order])], pa.binary()), pa.array([pack(dst[order])], pa.binary())], ["n", "a", "b"])

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

    whole = edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).where("src is not null and dst is not null")
    return written(whole.mapInArrow(run, "n long, a binary, b binary"), "arcs")


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Both ends of the edges of each packed row."""
    for batch in batches:
        for a, b in zip(batch.column(0), batch.column(1)):
            yield unpack_sorted(a.as_py()), unpack(b.as_py())


def unpacked(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, dst in read(batches):
            for i in range(0, len(src), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (src, dst)], ["src", "dst"])

    return rows.select("a", "b").mapInArrow(run, "src long, dst long")


class Stars:
    """Ids in order, for each the place of the least id known to be in its component, and its edges out."""

    def __init__(self):
        self.ids, self.label, self.out = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held, self.n = [], 0

    def add(self, src: np.ndarray, dst: np.ndarray, many: np.ndarray) -> None:
        self.held.append((src, dst, many))
        self.n += len(src)
        if self.n >= MERGED_EDGES:
            self.merge()

    def merge(self) -> None:
        if not self.held:
            return
        src, dst, many = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n = [], 0
        ids = distinct(np.r_[self.ids, src, dst])
        own, a = np.searchsorted(ids, self.ids), np.searchsorted(ids, src)
        out = np.bincount(a, many, len(ids)).astype(np.int64)
        out[own] += self.out
        label = local.components(np.arange(len(ids)), np.r_[a, own], np.r_[np.searchsorted(ids, dst), own[self.label]])[1]
        self.ids, self.label, self.out = ids, label, out


def components(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids in order, the least id of each one's component and its edges out. Tasks leave a star for each component that
    they see, one task joins these. None: more than ``most`` nodes."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars = Stars()
        for src, dst in read(batches):
            stars.add(src, dst, np.ones(len(src), np.int64))
        stars.merge()
        for i in range(0, len(stars.ids), ROW_EDGES):
            x = slice(i, i + ROW_EDGES)
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (pack_sorted(stars.ids[x]), pack(stars.ids[stars.label[x]]), pack(stars.out[x]))], ["a", "b", "c"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars = Stars()
        for batch in batches:
            for a, b, c in zip(*batch.columns):
                stars.add(unpack_sorted(a.as_py()), unpack(b.as_py()), unpack(c.as_py()))
        stars.merge()
        large = len(stars.ids) > most
        out = ([None], [None], [None]) if large else (stars.ids, stars.ids[stars.label], stars.out)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["id", "label", "out"])

    few = 2 * rows.sparkSession.sparkContext.defaultParallelism
    found = rows.select("a", "b").coalesce(few).mapInArrow(some, "a binary, b binary, c binary").repartition(1).mapInArrow(last, "id long, label long, out long").toArrow()
    if found.column(0).null_count:
        return None
    return tuple(found.column(k).to_numpy() for k in range(3))


class Parts:
    """The parts of the graph of packed ``rows``; places of nodes follow each other within a part."""

    def __init__(self, rows: DataFrame, ids: np.ndarray, label: np.ndarray, out: np.ndarray):
        self.rows, self.ids = rows, ids
        order = np.argsort(label, kind="stable")
        self.by_place = ids[order]
        self.place = np.empty(len(ids), np.int32)
        self.place[order] = np.arange(len(ids))
        label = label[order]
        first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]]) if len(ids) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(ids)])
        large = size >= TOGETHER_NODES
        group = first // TOGETHER_NODES
        new = np.r_[True, large[1:] | large[:-1] | (group[1:] != group[:-1])] if len(first) else np.zeros(0, bool)
        self.first = first[new]
        self.size = np.diff(np.r_[self.first, len(ids)])
        self.edges = np.add.reduceat(out[order], self.first) if len(ids) else self.first

    def search(self, together: int, tasks: int, work: Callable) -> DataFrame:
        """``id, score`` of ``work(n, a, b, sources)``, which gives places and scores, for the nodes of each part in batches
        of ``together``. Batches are dealt by hash, as searches from neighbouring nodes take about as long."""
        spark = self.rows.sparkSession
        batches = -(-self.size // together)
        load = self.size * self.edges.astype(float)
        shares = np.minimum(np.maximum(1, np.ceil(tasks * load / max(1.0, load.sum()))), np.maximum(1, batches)).astype(np.int64)
        unit = np.r_[0, np.cumsum(shares)]  # the first share of each part
        sent = spark.sparkContext.broadcast((self.ids, self.place, self.first, shares, unit))
        ends = spark.sparkContext.broadcast((self.by_place, self.first, self.size, shares, unit))

        def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, place, first, shares, unit = sent.value
            for src, dst in read(rows):
                a, b = place[np.searchsorted(ids, src)], place[np.searchsorted(ids, dst)]
                order = np.argsort(a, kind="stable")
                order = order[a[order] != b[order]]
                a, b = a[order], b[order]
                units, blobs = [], []
                for p, i, j in runs(np.searchsorted(first, a, "right") - 1):
                    blob = pack_sorted(a[i:j] - first[p]), pack(b[i:j] - first[p])
                    units += range(unit[p], unit[p] + shares[p])
                    blobs += [blob] * int(shares[p])
                for i in range(0, len(units), 64):
                    x, y = zip(*blobs[i : i + 64])
                    yield pa.RecordBatch.from_arrays([pa.array(units[i : i + 64], pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["unit", "a", "b"])

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_place, first, size, shares, unit = ends.value
            at, held = None, []

            def done() -> pa.RecordBatch:
                p = int(np.searchsorted(unit, at, "right")) - 1
                a, b = (np.concatenate([x.pop(0) for x in held]) for _ in range(2))
                held.clear()
                low, n = int(first[p]), int(size[p])
                own = np.sort(np.argsort(mixed(np.arange(-(-n // together))))[at - unit[p] :: shares[p]])
                sources = np.concatenate([np.zeros(0, np.int64), *(np.arange(k * together, min(n, (k + 1) * together)) for k in own.tolist())])
                places, score = work(n, a, b, sources)
                return pa.RecordBatch.from_arrays([pa.array(by_place[low + places]), pa.array(score)], ["id", "score"])

            for batch in rows:
                for u, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    if u != at and held:
                        yield done()
                    at = u
                    held.append([unpack_sorted(a.as_py()).astype(np.int32), unpack(b.as_py()).astype(np.int32)])
            if held:
                yield done()

        dealt = self.rows.select("a", "b").mapInArrow(deal, "unit long, a binary, b binary")
        return dealt.repartition(int(max(1, min(4 * unit[-1], 8 * tasks))), "unit").sortWithinPartitions("unit").mapInArrow(run, "id long, score double")
