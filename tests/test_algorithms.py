"""Algorithms against small graphs with known answers, and the sequential ones against brute force."""

import itertools

import pytest

from weftgraph.algo import sequential
from weftgraph.algo.library import Algorithms, register_algorithm
from weftgraph.sources.graph import PropertyGraph

#: Two triangles joined by a bridge, and a tail.
PAIRS = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (6, 7)]


@pytest.fixture(scope="module")
def a(spark):
    nodes = [(i, ["N"], {}) for i in range(1, 9)]
    return Algorithms(PropertyGraph.of_rows(spark, nodes, [(x, y, "E", {"weight": float(x + y)}) for x, y in PAIRS]))


def pairs(df, *names):
    return dict((r[names[0]], r[names[1]]) for r in df.collect())


def test_structure(a):
    assert pairs(a.connected_components(), "id", "component") == {**dict.fromkeys(range(1, 8), 1), 8: 8}
    assert pairs(a.strongly_connected_components(), "id", "component") == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8}
    assert pairs(a.kcore(), "id", "core") == {1: 2, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2, 7: 1, 8: 0}
    assert a.articulation_points() == [3, 4, 6] and a.bridges() == [(3, 4), (6, 7)]
    assert sorted(map(tuple, a.triangles().collect())) == [(1, 2, 3), (4, 5, 6)]
    assert not a.is_dag() and a.topological_sort() is None


def test_traversal_and_paths(a):
    assert pairs(a.bfs(1), "id", "depth") == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6}
    assert a.bfs(99).count() == 0
    assert a.dfs(4) == [7, 6, 5, 4]
    assert pairs(a.dijkstra(4, weight="weight"), "id", "distance") == {4: 0.0, 5: 9.0, 6: 20.0, 7: 33.0}
    assert a.dijkstra_path(1, 7, "weight")[1] == [1, 2, 3, 4, 5, 6, 7]
    assert a.astar(7, 1) is None
    best, negative = a.bellman_ford(1, "weight")
    assert not negative and pairs(best, "id", "distance")[4] == 15.0
    assert {(r[0], r[1]): r[2] for r in a.floyd_warshall("weight").collect()}[1, 3] == 8.0


def test_centrality(a):
    ranks = pairs(a.pagerank(), "id", "score")
    assert abs(sum(ranks.values()) - 1) < 1e-6 and ranks[8] < min(v for k, v in ranks.items() if k != 8)
    assert pairs(a.degree_centrality(), "id", "total")[3] == 3
    assert pairs(a.closeness_centrality(), "id", "score")[6] == 0.75
    assert max(pairs(a.betweenness_centrality(), "id", "score").items(), key=lambda x: x[1])[0] in (3, 4)


def test_communities(a):
    labels, score = a.louvain()
    found = pairs(labels, "id", "label")
    assert found[1] == found[2] == found[3] != found[4] == found[5] == found[6] and score > 0.2
    spread = pairs(a.label_propagation(), "id", "label")
    assert spread[8] == 8 and spread[1] == spread[2] == spread[3]


def test_trees(a):
    tree = a.kruskal("weight").collect()
    assert len(tree) == 6 and sum(r["weight"] for r in tree) == sum(w for _, _, w in a.prim("weight"))


def test_flows():
    edges = [(0, 1, 3.0, 1.0), (0, 2, 2.0, 2.0), (1, 2, 1.0, 1.0), (1, 3, 2.0, 3.0), (2, 3, 3.0, 1.0)]
    value, flow = sequential.max_flow([e[:3] for e in edges], 0, 3)
    assert value == 5.0 and all(0 <= f <= c for (x, y), f in flow.items() for a, b, c, _ in edges if (a, b) == (x, y))
    # brute force over whole flows
    best = None
    for f in itertools.product(*[range(int(c) + 1) for _, _, c, _ in edges]):
        net = {v: sum(x for x, e in zip(f, edges) if e[1] == v) - sum(x for x, e in zip(f, edges) if e[0] == v) for v in range(4)}
        if net[1] == net[2] == 0:
            key = (-net[3], sum(x * e[3] for x, e in zip(f, edges)))
            best = key if best is None else min(best, key)
    assert sequential.min_cost_max_flow(edges, 0, 3) == (-best[0], best[1])


def test_registry(a):
    register_algorithm("size", lambda graph: len(graph.nodes))
    assert a.run("size") == 1 and a.run("is_dag") is False
