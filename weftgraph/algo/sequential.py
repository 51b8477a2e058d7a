"""Algorithms that are sequential by nature, on adjacency held by one process.

They take plain Python edges. :class:`.library.Algorithms` checks the size before it collects a graph for them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from heapq import heappop, heappush

EPS = 1e-9


def adjacency(edges: list[tuple]) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for a, b, *rest in sorted(edges):
        out.setdefault(a, []).append((b, *rest))
    return out


def dfs(edges: list[tuple], start: int, seen: set[int] | None = None) -> list[int]:
    """Nodes in the order in which their search ends, smaller neighbours first."""
    out, near = [], adjacency(edges)
    seen = set() if seen is None else seen
    if start in seen:
        return out
    seen.add(start)
    stack = [(start, iter(near.get(start, ())))]
    while stack:
        v, todo = stack[-1]
        w = next((x[0] for x in todo if x[0] not in seen), None)
        if w is None:
            out.append(v)
            stack.pop()
        else:
            seen.add(w)
            stack.append((w, iter(near.get(w, ()))))
    return out


def dfs_all(nodes: list[int], edges: list[tuple]) -> list[int]:
    seen: set[int] = set()
    return [v for s in sorted(nodes) for v in dfs(edges, s, seen)]


@dataclass(frozen=True)
class Event:
    """What a visitor is told: ``discover`` and ``finish`` of a node; ``tree`` (to a new node), ``back`` (to a node
    whose search is still going on) and ``cross`` (to any other known node) of an edge."""

    kind: str
    node: int
    target: int | None = None


#: A visitor's answers: go on (None), do not go beyond this node or edge, or end the whole walk with a value.
PRUNE = object()


@dataclass(frozen=True)
class Stop:
    value: object = None


class _Stopped(Exception):
    pass


def visit(edges: list[tuple], start: int, visitor: Callable[[Event], object], depth_first: bool = False):
    """Walk from ``start``, smaller neighbours first, telling ``visitor`` each :class:`Event`. Gives the value of the
    visitor's :class:`Stop`, or None where the walk came to its end."""
    near, state, ended = adjacency(edges), {start: "open"}, []

    def tell(kind: str, node: int, target: int | None = None) -> bool:
        answer = visitor(Event(kind, node, target))
        if isinstance(answer, Stop):
            ended.append(answer.value)
            raise _Stopped
        return answer is not PRUNE

    def children(node: int):
        return iter([x[0] for x in near.get(node, ())])

    def follow(node: int, target: int) -> bool:
        """Whether the walk goes on to ``target``."""
        if target in state:
            tell("back" if depth_first and state[target] == "open" else "cross", node, target)
            return False
        if not tell("tree", node, target):
            return False
        state[target] = "open"
        if tell("discover", target):
            return True
        tell("finish", target)
        state[target] = "done"
        return False

    try:
        if not tell("discover", start):
            tell("finish", start)
            return None
        if depth_first:
            stack = [(start, children(start))]
            while stack:
                node, todo = stack[-1]
                target = next(todo, None)
                if target is None:
                    tell("finish", node)
                    state[node] = "done"
                    stack.pop()
                elif follow(node, target):
                    stack.append((target, children(target)))
        else:
            queue = deque([start])
            while queue:
                node = queue.popleft()
                queue += [t for t in children(node) if follow(node, t)]
                tell("finish", node)
                state[node] = "done"
    except _Stopped:
        return ended[0]
    return None


def astar(edges: list[tuple], source: int, target: int, guess: Callable[[int], float]) -> tuple[float, list[int]] | None:
    """Distance and path; the shortest where ``guess`` never overestimates."""
    near, best, came = adjacency(edges), {source: 0.0}, {}
    heap, closed = [(guess(source), source)], set()
    while heap:
        _, v = heappop(heap)
        if v == target:
            path = [v]
            while v in came:
                v = came[v]
                path.append(v)
            return best[target], path[::-1]
        if v in closed:
            continue
        closed.add(v)
        for w, weight in near.get(v, ()):
            d = best[v] + weight
            if d < best.get(w, float("inf")) - EPS:
                best[w], came[w] = d, v
                closed.discard(w)
                heappush(heap, (d + guess(w), w))
    return None


def prim(nodes: list[int], edges: list[tuple], start: int | None = None) -> list[tuple]:
    """A minimum spanning tree of the part that ``start`` can reach, edges taken as undirected."""
    near = adjacency([(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges])
    if not nodes:
        return []
    start = min(nodes) if start is None else start
    seen, heap, out = {start}, [(w, start, b) for b, w in near.get(start, ())], []
    heap.sort()
    while heap:
        w, a, b = heappop(heap)
        if b not in seen:
            seen.add(b)
            out.append((a, b, w))
            for c, x in near.get(b, ()):
                if c not in seen:
                    heappush(heap, (x, b, c))
    return out


def max_flow(edges: list[tuple], source: int, sink: int) -> tuple[float, dict[tuple[int, int], float]]:
    """Value and flow on each pair, by shortest augmenting paths; parallel capacities add up."""
    room: dict[int, dict[int, float]] = {}
    given: dict[tuple[int, int], float] = {}
    for a, b, c in edges:
        if a != b:
            room.setdefault(a, {})[b] = room.get(a, {}).get(b, 0.0) + c
            room.setdefault(b, {}).setdefault(a, 0.0)
            given[a, b] = given.get((a, b), 0.0) + c
    total = 0.0
    while source in room and source != sink:
        came, queue = {source: source}, deque([source])
        while queue and sink not in came:
            v = queue.popleft()
            for w in sorted(room[v]):
                if w not in came and room[v][w] > EPS:
                    came[w] = v
                    queue.append(w)
        if sink not in came:
            break
        path, v = [], sink
        while v != source:
            path.append((came[v], v))
            v = came[v]
        push = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= push
            room[b][a] += push
        total += push
    return total, {(a, b): max(0.0, c - room[a][b]) for (a, b), c in given.items() if c - room[a][b] > EPS}


def min_cost_max_flow(edges: list[tuple], source: int, sink: int) -> tuple[float, float]:
    """Value and cost, by cheapest augmenting paths. ``edges``: from, to, capacity, cost; parallel edges stay
    apart, each with its own cost."""
    arcs: list[list] = []  # to, room, cost; the reverse of arc k is k ^ 1
    out: dict[int, list[int]] = {}
    for a, b, c, cost in edges:
        for x, y, r, k in ((a, b, c, cost), (b, a, 0.0, -cost)):
            out.setdefault(x, []).append(len(arcs))
            arcs.append([y, r, k])
    total = spent = 0.0
    while True:
        best, came, queue, waiting = {source: 0.0}, {}, deque([source]), {source}
        while queue:
            v = queue.popleft()
            waiting.discard(v)
            for k in out.get(v, ()):
                w, r, cost = arcs[k]
                if r > EPS and best[v] + cost < best.get(w, float("inf")) - EPS:
                    best[w], came[w] = best[v] + cost, k
                    if w not in waiting:
                        queue.append(w)
                        waiting.add(w)
        if sink not in best or sink == source:
            return total, spent
        path, v = [], sink
        while v != source:
            path.append(came[v])
            v = arcs[came[v] ^ 1][0]
        push = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push
        total += push
        spent += push * best[sink]


def cut_parts(nodes: list[int], edges: list[tuple]) -> tuple[set[int], set[tuple[int, int]]]:
    """Articulation points and bridges (smaller id first) of the undirected simple graph."""
    near: dict[int, set[int]] = {v: set() for v in nodes}
    for a, b, *_ in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found, low, points, bridges, clock = {}, {}, set(), set(), 0
    for root in sorted(near):
        if root in found:
            continue
        found[root] = low[root] = clock
        clock += 1
        children, stack = 0, [(root, None, iter(sorted(near[root])))]
        while stack:
            v, parent, todo = stack[-1]
            w = next(todo, None)
            if w is None:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] > found[parent]:
                        bridges.add((min(v, parent), max(v, parent)))
                    if parent != root and low[v] >= found[parent]:
                        points.add(parent)
            elif w not in found:
                found[w] = low[w] = clock
                clock += 1
                children += v == root
                stack.append((w, v, iter(sorted(near[w]))))
            elif w != parent:
                low[v] = min(low[v], found[w])
        if children > 1:
            points.add(root)
    return points, bridges


def louvain(nodes: list[int], edges: list[tuple], resolution: float = 1.0) -> dict[int, int]:
    """Communities by moving nodes while that raises modularity, then the same on the graph of communities,
    until nothing moves. Labels are the smallest member. Edges may have a weight."""
    weight: dict[int, dict[int, float]] = {v: {} for v in nodes}
    for a, b, *given in edges:
        x = float(given[0]) if given else 1.0
        weight.setdefault(a, {})
        weight.setdefault(b, {})
        weight[a][b] = weight[a].get(b, 0.0) + x
        weight[b][a] = weight[b].get(a, 0.0) + x
    member = {v: v for v in weight}
    twice = sum(sum(x.values()) for x in weight.values())
    if twice == 0:
        return member
    while True:
        degree = {v: sum(weight[v].values()) for v in weight}
        place, total = {v: v for v in weight}, dict(degree)
        moved_any, moving = False, True
        while moving:
            moving = False
            for v in sorted(weight):
                links: dict[int, float] = {}
                for w, x in weight[v].items():
                    if w != v:
                        links[place[w]] = links.get(place[w], 0.0) + x
                home = place[v]
                total[home] -= degree[v]
                gain = lambda c: links.get(c, 0.0) - resolution * total[c] * degree[v] / twice
                best = max(sorted(links), key=gain, default=home)
                if gain(best) <= gain(home) + 1e-12:
                    best = home
                total[best] += degree[v]
                if best != home:
                    place[v], moving, moved_any = best, True, True
        if not moved_any:
            break
        member = {v: place[c] for v, c in member.items()}
        merged: dict[int, dict[int, float]] = {c: {} for c in set(place.values())}
        for v, near in weight.items():
            for w, x in near.items():
                a, b = place[v], place[w]
                merged[a][b] = merged[a].get(b, 0.0) + x
        weight = merged
    least: dict[int, int] = {}
    for v, c in member.items():
        least[c] = min(v, least.get(c, v))
    return {v: least[c] for v, c in member.items()}
