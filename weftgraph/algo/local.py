"""Graph algorithms on index arrays, for graphs that one task can hold.

:class:`.library.Algorithms` counts edges and nodes first and comes here only below a stated bound; larger graphs
take the rounds of :mod:`.iterative`, with the same results. The work runs in one task on an executor, so nothing
goes to the driver. ``a`` and ``b`` are places of the ends of each edge among the sorted ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_one_task(edges: DataFrame, nodes: DataFrame | None, work: Callable, schema: str, weight: bool = False) -> DataFrame:
    """``work(ids, a, b[, w])`` gives columns in the order of ``schema``. ``nodes`` adds nodes without edges."""
    names = [c.split()[0] for c in schema.split(", ")]
    rows = edges.select("src", "dst", *(["weight"] if weight else []))
    if nodes is not None:
        rows = rows.unionAll(nodes.select("id", F.lit(None).cast("bigint"), *([F.lit(None).cast("double")] if weight else [])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in (b.column(0), b.column(1).fill_null(0), b.column(1).is_valid(), *b.columns[2:])] for b in batches if b.num_rows]
        if not parts:
            return
        src, dst, arc, *w = (np.concatenate(x) for x in zip(*parts))
        arc = arc.astype(bool)
        ids = np.unique(np.r_[src, dst[arc]])
        a, b = np.searchsorted(ids, src[arc]), np.searchsorted(ids, dst[arc])
        out = work(ids, a, b, *(x[arc].astype(float) for x in w))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)

    return rows.repartition(1).mapInArrow(run, schema)


def pagerank(ids, a, b, damping: float, max_iterations: int, tolerance: float):
    n = len(ids)
    out = np.bincount(a, minlength=n)
    share, dangling = 1.0 / out[a], out == 0
    score = np.full(n, 1.0 / n)
    for _ in range(max_iterations):
        base = (1.0 - damping) / n + damping * score[dangling].sum() / n
        new = base + damping * np.bincount(b, score[a] * share, n)
        moved = np.abs(new - score).max()
        score = new
        if moved < tolerance:
            break
    return ids, score


def components(ids, a, b):
    """Least labels spread over the edges; after each round every label takes its label's label, to the end."""
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, label):
            return ids, ids[label]
        label = new


def rows_of(a: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges in the order of one end, and where those of each node begin."""
    order = np.argsort(a, kind="stable")
    return order, np.r_[0, np.cumsum(np.bincount(a, minlength=n))]


def edges_at(order: np.ndarray, begin: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """All edges of some nodes."""
    size = begin[nodes + 1] - begin[nodes]
    upto = np.cumsum(size)
    return order[np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin[nodes] - upto + size, size)]


def bfs(ids, a, b, start: int):
    at = np.searchsorted(ids, start)
    if at == len(ids) or ids[at] != start:
        return ids[:0], np.zeros(0, np.int64)
    order, begin = rows_of(a, len(ids))
    depth, front, d = np.full(len(ids), -1), np.array([at]), 0
    while len(front):
        depth[front] = d
        near = np.unique(b[edges_at(order, begin, front)])
        front, d = near[depth[near] < 0], d + 1
    seen = np.flatnonzero(depth >= 0)
    return ids[seen], depth[seen]


def layers(ids, a, b):
    """Layer of each node; -1 where a cycle is in the way."""
    pairs = np.unique(a * len(ids) + b)
    a, b = pairs // len(ids), pairs % len(ids)
    order, begin = rows_of(a, len(ids))
    waits, layer, d = np.bincount(b, minlength=len(ids)), np.full(len(ids), -1), 0
    front = np.flatnonzero(waits == 0)
    while len(front):
        layer[front] = d
        near, less = np.unique(b[edges_at(order, begin, front)], return_counts=True)
        waits[near] -= less
        front, d = near[waits[near] == 0], d + 1
    return ids, layer


def simple(a, b, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Both directions of each edge, once; no self-loops."""
    pairs = np.unique(np.r_[a * n + b, b * n + a])
    u, v = pairs // n, pairs % n
    return u[u != v], v[u != v]


def cores(ids, a, b):
    n = len(ids)
    u, v = simple(a, b, n)
    order, begin = rows_of(u, n)
    degree, core, live, k = np.bincount(u, minlength=n), np.full(n, -1), np.arange(n), 0
    while len(live):
        k = max(k, int(degree[live].min()))
        front = live[degree[live] <= k]
        while len(front):
            core[front] = k
            near, less = np.unique(v[edges_at(order, begin, front)], return_counts=True)
            degree[near] -= less
            front = near[(core[near] < 0) & (degree[near] <= k)]
        live = live[core[live] < 0]
    return ids, core


def labels(ids, a, b, max_iterations: int):
    n = len(ids)
    u, v = np.r_[a, b, np.arange(n)], np.r_[b, a, np.arange(n)]
    label = np.arange(n)
    for _ in range(max_iterations):
        cell, votes = np.unique(u * n + label[v], return_counts=True)
        owner, choice = cell // n, cell % n
        order = np.lexsort((choice, -votes, owner))
        new = choice[order][np.r_[True, owner[order][1:] != owner[order][:-1]]]
        if np.array_equal(new, label):
            break
        label = new
    return ids, ids[label]


def reached(order: np.ndarray, begin: np.ndarray, b: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether some of the nodes ``own`` lead to a node or are it; ``order`` and ``begin`` as of :func:`rows_of`."""
    there = np.zeros(len(begin) - 1, bool)
    there[own] = True
    front = np.flatnonzero(there)
    while len(front):
        near = b[edges_at(order, begin, front)]
        near = near[~there[near]]
        there[near] = True
        front = np.unique(near)
    return there


#: What looking up an edge takes beside passing it by, and searches for which the part of the graph that they reach is cut out.
FOLLOWED, GROUP = 16, 512


def closeness(ids, a, b, improved: bool, sources: np.ndarray | None = None, of: int | None = None):
    """Searches from 64 nodes at a time, a bit for each: a node's word says which of them have reached it. A level goes
    over the edges out of nodes that were reached last, and only those into nodes that some search has not reached.
    Scores of ``sources``, or all; ``of``: the nodes of the whole graph, if this is a part."""
    n = len(ids)
    of = n if of is None else of
    sources = np.arange(n) if sources is None else sources
    order = np.argsort(b, kind="stable")
    tail, head = a[order], b[order]
    by_tail, begin = rows_of(tail, n)
    score = np.zeros(len(sources))
    for group in range(0, len(sources), GROUP):
        there = reached(by_tail, begin, head, sources[group : group + GROUP])
        nodes, kept = np.flatnonzero(there), there[tail]
        place, spot = np.zeros(n, np.int64), np.cumsum(kept, dtype=np.int32) - np.int32(1)
        place[nodes] = np.arange(len(nodes))
        a, b, m = place[tail[kept]], place[head[kept]], len(nodes)
        out, into = np.diff(begin)[nodes], np.bincount(b, minlength=m)
        flags, front = np.zeros(m, bool), np.zeros(m, np.uint64)
        for low in range(group, min(group + GROUP, len(sources)), 64):
            own = place[sources[low : min(low + 64, group + GROUP)]]
            seen = np.zeros(m, np.uint64)
            seen[own] = np.uint64(1) << np.arange(len(own)).astype(np.uint64)
            front[own] = seen[own]
            every = np.bitwise_or.reduce(seen[own])
            live, left, open_, d, far, total = own, None, np.ones(m, bool), 0, np.zeros(64), np.zeros(64)
            while len(live):
                d += 1
                size = len(b) if left is None else len(left)
                if out[live].sum() * FOLLOWED < size:
                    pick = np.sort(spot[edges_at(by_tail, begin, nodes[live])])
                else:
                    if into[open_].sum() * 2 < size:
                        left = np.flatnonzero(open_.take(b, mode="clip")) if left is None else left[open_[b[left]]]
                    flags[:] = False
                    flags[live] = True
                    pick = np.flatnonzero(flags.take(a, mode="clip")) if left is None else left[flags[a[left]]]
                heads = b[pick]
                starts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]]) if len(pick) else pick
                heads = heads[starts]
                new = np.bitwise_or.reduceat(front.take(a[pick], mode="clip"), starts) & ~seen[heads] if len(pick) else front[:0]
                front[live] = 0
                hit = np.flatnonzero(new)
                live, new = heads[hit], new[hit]
                front[live] = new
                seen[live] |= new
                open_[live] = seen[live] != every
                bits = np.unpackbits(new.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
                far += bits
                total += d * bits.astype(float)
            r, t = far[: len(own)], total[: len(own)]
            score[low : low + len(own)] = np.where(t > 0, r / np.maximum(t, 1), 0.0) * (r / (of - 1) if improved and of > 1 else 1.0)
    return ids[sources], score


#: Numbers in a table of nodes by sources, numbers of edges' rows that are added at a time, and what following an edge for one
#: source takes beside adding one number of a row.
CELLS, GATHERED, SINGLE = 1 << 22, 1 << 16, 32
#: Rows that are worth adding in one step.
FEW = 8
#: Sources whose searches go together.
TOGETHER = 128


def added_rows(to: np.ndarray, many: int, rows: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some of ``many`` places and for each the sum of the rows ``of`` that edges bring ``to`` it, in the rows' own type, until all
    that edges lead to have come; ``to`` does not fall. Places with about as many edges go together, an edge of each at a
    time, so that a step adds many rows; what is left of the few with the most edges is added up place by place."""
    k = rows.shape[1]
    degree = np.bincount(to, minlength=many)
    begin = np.cumsum(degree) - degree
    order = np.argsort(-degree, kind="stable")[: np.count_nonzero(degree)]
    some = max(1, GATHERED // k)
    got = np.empty((some, k), rows.dtype)
    for i in range(0, len(order), some):
        place = order[i : i + some]
        first, size = begin[place], degree[place]
        sums, m = np.zeros((len(place), k), rows.dtype), len(place)
        for j in range(int(size[0])):
            while size[m - 1] <= j:
                m = int(np.searchsorted(-size, -j))
            if m < FEW:
                for x in range(m):
                    end = int(first[x] + size[x])
                    for y in range(int(first[x]) + j, end, some):
                        sums[x] += rows[of[y : min(y + some, end)]].sum(0, dtype=rows.dtype)
                break
            sums[:m] += np.take(rows, of[first[:m] + j], axis=0, out=got[:m], mode="clip")
        yield place, sums


def among(flags: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different nodes of ``x``, which ``flags`` is as long as all nodes to hold, and each one's place among them."""
    flags[:] = False
    flags[x] = True
    nodes = np.flatnonzero(flags)
    place = np.empty(len(flags), np.int32)
    place[nodes] = np.arange(len(nodes))
    return nodes, place[x]


def dependencies(a, b, n: int, sources: np.ndarray) -> np.ndarray:
    """Brandes' accumulation over some sources, for ``TOGETHER`` of them at a time, fewer in a large graph, on the part of the
    graph that these and those of the next batches reach."""
    order = np.argsort(a, kind="stable")
    a, b = a[order].astype(np.int32), b[order].astype(np.int32)
    degree = np.bincount(a, minlength=n)
    begin, every = np.r_[0, np.cumsum(degree)], np.arange(len(a), dtype=np.int32)
    by_head = np.argsort(b, kind="stable").astype(np.int32)
    tail, head = a[by_head], b[by_head]
    total = np.zeros(n)
    width = max(1, min(TOGETHER, len(sources), CELLS // max(1, n)))
    # kept from batch to batch, as fresh memory takes longer than what is done with it
    tables = [np.empty(n * width, kind) for kind in (float, np.int16 if n < 1 << 15 else np.int32, float, float)]
    for group in range(0, len(sources), max(GROUP, width) // width * width):
        near = sources[group : group + max(GROUP, width) // width * width]
        there = reached(every, begin, b, near)
        nodes, out = np.flatnonzero(there), there[a]
        place = np.zeros(n, np.int32)
        place[nodes] = np.arange(len(nodes))
        kept, turned = np.flatnonzero(out), np.cumsum(out, dtype=np.int32) - np.int32(1)
        into = np.flatnonzero(there[tail])
        part = place[a[kept]], place[b[kept]], turned[by_head[into]], place[tail[into]], place[head[into]]
        for at in range(0, len(near), width):
            total[nodes] += shares(*part, len(nodes), place[near[at : at + width]].astype(np.int64), tables)
    return total


def shares(a, b, by_head, tail, head, n: int, own: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """What the sources ``own`` add to each of ``n`` nodes, level by level: a table has a row for each node and a column for
    each source. A level of few nodes follows their edges for each source; one of many goes over the edges between its
    nodes and the next once for all sources, a row at a time. Edges are in the order of their first ends, and again of
    their second, where ``by_head`` says which they are. ``tables`` are written over."""
    k, degree = len(own), np.bincount(a, minlength=n)
    begin, every = np.r_[0, np.cumsum(degree)], np.arange(len(a), dtype=np.int32)
    flags, own_edges = np.zeros(n, bool), np.zeros(len(a), bool)
    block = max(1, GATHERED // k)
    paths, depth, share, spare = (t[: n * k].reshape(n, k) for t in tables)
    paths[:], depth[:], share[:] = 0.0, -1, 0.0
    flat_paths, flat_depth, flat_share = paths.ravel(), depth.ravel(), share.ravel()
    front = own * k + np.arange(k)
    flat_paths[front], flat_depth[front] = 1.0, 0
    # of each step: places of the level's nodes in the table and the edges to the next; or the rows of both levels and the
    # edges between, after a step for all sources
    steps, open_, left = [], np.ones(n, bool), None
    live, many, top = None, k, 1.0  # top: the most paths to a place of the level
    while many:
        d = len(steps) + 1
        work = int(degree[front // k].sum() if live is None else per_row @ degree[live])
        wide = work * SINGLE > n
        if wide:
            rows = np.unique(front // k) if live is None else live
            most = int(degree[rows].sum())
            wide = work * SINGLE > (most if left is None else min(most, len(left))) * k
        if wide:
            flags[:] = False
            flags[rows] = True
            left = np.flatnonzero(open_[head]) if left is None else left[open_[head[left]]]
            pick = left[flags[tail[left]]]
            (low, of), (high, to) = among(flags, tail[pick]), among(flags, head[pick])
            most = top * int(np.bincount(to).max(initial=0))  # of the sums, which take the smallest type that holds them
            sent = spare.ravel().view(np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else float)[: len(low) * k].reshape(-1, k)
            for i in range(0, len(low), block):
                x = low[i : i + block]
                np.multiply(paths[x], depth[x] == d - 1, out=sent[i : i + block], casting="unsafe")
            found, top = [(high[:0], high[:0])], 0.0
            for x, new in added_rows(to, len(high), sent, of):
                x = high[x]
                before = depth[x]
                hit = before < 0
                hit &= new > 0
                got = np.count_nonzero(hit, axis=1)
                if not got.any():
                    continue
                new *= hit
                top = max(top, float(new.max()))
                before += hit * before.dtype.type(d + 1)
                depth[x] = before
                paths[x] += new
                open_[x] = (before < 0).any(1)
                found.append((x[got > 0], got[got > 0]))
            high, per_row = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(high)
            high, per_row = high[order], per_row[order]
            steps.append((low, high, by_head[pick]))
            live, many = high, int(per_row.sum())
        else:
            if live is not None:
                at_row, col = np.nonzero(depth[live] == d - 1)
                front, live = live[at_row] * k + col, None
            node = front // k
            of = np.repeat(np.arange(len(front)), degree[node])
            to = b[edges_at(every, begin, node)] * np.int64(k) + (front - node * k)[of]
            new = flat_depth[to] < 0
            of, to = of[new], to[new]
            steps.append((front, of, to, None))
            np.add.at(flat_paths, to, flat_paths[front[of]])
            flat_depth[to] = d
            front = np.sort(to)
            front = front[np.r_[True, front[1:] != front[:-1]]] if len(front) else front
            many, top = len(front), float(flat_paths[front].max(initial=0.0))
    # the last step found nothing; a source takes no share of its own paths, so the step out of it is left out
    steps.pop()
    for d in range(len(steps), 1, -1):
        step = steps.pop()
        if len(step) == 4:
            front, of, to, _ = step
            flat_share[front] += flat_paths[front] * np.bincount(of, (1.0 + flat_share[to]) / flat_paths[to], len(front))
            continue
        low, high, pick = step
        flags[:] = False
        flags[high] = True
        if 4 * len(pick) > len(a):
            there = np.zeros(n, bool)
            there[low] = True
            pick = np.flatnonzero(there[a] & flags[b])
        else:
            own_edges[:] = False
            own_edges[pick[flags[b[pick]]]] = True
            pick = np.flatnonzero(own_edges)  # by their first ends
        (low, to), (high, of) = among(flags, a[pick]), among(flags, b[pick])
        sent = spare[: len(high)]
        for i in range(0, len(high), block):
            x = high[i : i + block]
            out = np.add(share[x], 1.0, out=sent[i : i + block])
            out /= np.maximum(paths[x], 1.0)
            out *= depth[x] == d
        for x, back in added_rows(to, len(low), sent, of):
            x = low[x]
            back *= paths[x]
            back *= depth[x] == d - 1
            share[x] += back
    return share.sum(1)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A breadth-first forest from the least node of each component: parent (-1: a root), the edge to it, levels."""
    _, root = components(np.arange(n), a, b)
    order, begin = rows_of(np.r_[a, b], n)
    ends = np.r_[b, a]
    parent, edge, seen = np.full(n, -1), np.full(n, -1), np.zeros(n, bool)
    front = np.flatnonzero(root == np.arange(n))
    levels = []
    while len(front):
        seen[front] = True
        levels.append(front)
        e = edges_at(order, begin, front)
        e = e[~seen[ends[e]]]
        front, first = np.unique(ends[e], return_index=True)
        edge[front] = e[first] % max(1, len(a))
        parent[front] = a[edge[front]] + b[edge[front]] - front
    return parent, edge, levels


def sparse(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places of at most 2 n edges with the same blocks: a breadth-first forest and one of what is left. Any further
    edges have the same blocks with these as with all (Cheriyan, Kao, Thurimella; Eppstein and others)."""
    kept = np.zeros(len(a), bool)
    for _ in range(2):
        rest = np.flatnonzero(~kept)
        edge = forest(a[rest], b[rest], n)[1]
        kept[rest[edge[edge >= 0]]] = True
    return np.flatnonzero(kept)


def cut_parts(ids, a, b):
    """Articulation points (an id, null) and bridges (smaller id first) of a simple graph, by the blocks of Tarjan and
    Vishkin: tree edges are of one block where an edge leads past the node between them."""
    n = len(ids)
    parent, edge, levels = forest(a, b, n)
    size = np.ones(n, np.int64)
    for level in levels[:0:-1]:
        np.add.at(size, parent[level], size[level])
    pre = np.zeros(n, np.int64)
    if levels:
        pre[levels[0]] = np.cumsum(size[levels[0]]) - size[levels[0]]
    for level in levels[1:]:
        level = level[np.argsort(parent[level], kind="stable")]
        upto = np.cumsum(size[level]) - size[level]
        first = np.r_[True, parent[level][1:] != parent[level][:-1]]
        pre[level] = pre[parent[level]] + 1 + upto - upto[first][np.cumsum(first) - 1]
    other = np.ones(len(a), bool)
    other[edge[edge >= 0]] = False
    u, v = a[other], b[other]
    low, high = pre.copy(), pre.copy()
    for x, y in ((u, v), (v, u)):
        np.minimum.at(low, x, pre[y])
        np.maximum.at(high, x, pre[y])
    for level in levels[:0:-1]:
        np.minimum.at(low, parent[level], low[level])
        np.maximum.at(high, parent[level], high[level])
    child = np.flatnonzero(parent >= 0)
    up = parent[child]
    joins = (parent[up] >= 0) & ((low[child] < pre[up]) | (high[child] >= pre[up] + size[up]))
    u, v = np.where(pre[u] < pre[v], u, v), np.where(pre[u] < pre[v], v, u)
    apart = pre[u] + size[u] <= pre[v]
    _, block = components(np.arange(n), np.r_[u[apart], child[joins]], np.r_[v[apart], up[joins]])
    sides = np.unique(np.r_[up, child] * n + np.r_[block[child], block[child]])
    points = np.flatnonzero(np.bincount(sides // n, minlength=n) > 1)
    alone = child[np.bincount(block[child], minlength=n)[block[child]] == 1]
    ends = ids[alone], ids[parent[alone]]
    return np.r_[ids[points], np.minimum(*ends)], pa.array(np.r_[ids[points], np.maximum(*ends)], mask=np.arange(len(points) + len(alone)) < len(points))


def blocks_of_packed(packed: DataFrame, most: int) -> DataFrame:
    """``src, dst`` as :func:`cut_parts` gives them, of edges that :func:`.packed.pairs` wrote. Each task thins its rows
    as it reads them, then one task thins what these leave, at most twice the nodes from each. More than ``most``
    nodes give one row of nulls."""
    from .packed import pack, pack_sorted, unpack, unpack_sorted

    def thinned(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        u = v = np.zeros(0, np.int64)
        for batch in batches:
            for x, y in zip(*(c.to_pylist() for c in batch.columns)):
                u, v = np.r_[u, unpack_sorted(x)], np.r_[v, unpack(y)]
                order = np.lexsort((v, u))
                order = order[np.r_[True, (np.diff(u[order]) != 0) | (np.diff(v[order]) != 0)]]
                u, v = u[order], v[order]
                ids = np.unique(np.r_[u, v])
                if len(u) > 2 * len(ids):
                    kept = sparse(np.searchsorted(ids, u), np.searchsorted(ids, v), len(ids))
                    u, v = u[kept], v[kept]
        return u, v

    def some(batches):
        u, v = thinned(batches)
        for k in range(0, len(u), 1 << 19):
            yield pa.RecordBatch.from_arrays([pa.array([pack_sorted(u[k : k + (1 << 19)])], pa.binary()), pa.array([pack(v[k : k + (1 << 19)])], pa.binary())], ["a", "b"])

    def last(batches):
        u, v = thinned(batches)
        ids = np.unique(np.r_[u, v])
        out = cut_parts(ids, np.searchsorted(ids, u), np.searchsorted(ids, v)) if len(ids) <= most else ([None], [None])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["src", "dst"])

    return packed.select("a", "b").mapInArrow(some, "a binary, b binary").repartition(1).mapInArrow(last, "src long, dst long")
