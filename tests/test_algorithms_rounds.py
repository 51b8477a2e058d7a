"""The distributed rounds of each algorithm and the arrays of one task give the same, and what definitions say."""

import itertools
import random

import numpy as np
import pytest

from weftgraph.algo import iterative, library, sequential
from weftgraph.algo.components import connected_components
from weftgraph.algo.library import Algorithms


def graphs():
    rng = random.Random(5)
    dense = [(a, b) for a, b in itertools.combinations(range(16), 2) if rng.random() < 0.3]
    return {
        "dense": dense + [(50, 51), (50, 51), (51, 52), (60, 60)],
        "cycle": [(0, 1), (1, 2), (2, 0), (2, 3), (4, 0)],
    }


@pytest.fixture(scope="module", params=["cycle", "dense"])
def both(request, spark):
    rows = graphs()[request.param]
    edges = spark.createDataFrame(rows, "src long, dst long")
    nodes = spark.createDataFrame([(x,) for x in sorted({y for r in rows for y in r} | {99})], "id long")
    return rows, Algorithms(nodes=nodes, edges=edges)


def table(df, *columns):
    return {r[0]: tuple(r)[1:] if len(r) > 2 else r[1] for r in df.select(*columns).collect()}


def near(a, b):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_both_ways_agree(both):
    rows, a = both
    assert a.small
    far = Algorithms(nodes=a.nodes, edges=a.edges)
    far.small = False
    start = rows[0][0]
    assert table(a.bfs(start), "id", "depth") == table(far.bfs(start), "id", "depth")
    assert table(a.connected_components(), "id", "component") == table(far.connected_components(), "id", "component")
    score = table(far.pagerank(max_iterations=10), "id", "score")
    assert near(table(a.pagerank(max_iterations=10), "id", "score"), score) and abs(sum(score.values()) - 1) < 1e-9
    assert table(a.kcore(), "id", "core") == table(far.kcore(), "id", "core")
    assert table(a.label_propagation(4), "id", "label") == table(far.label_propagation(4), "id", "label")
    assert near(table(a.closeness_centrality(), "id", "score"), table(far.closeness_centrality(), "id", "score"))
    (x, whole), (y, same) = a.topological_layers(), far.topological_layers()
    assert table(x, "id", "layer") == table(y, "id", "layer") and whole == same
    layer = table(x, "id", "layer")
    assert all(layer[s] < layer[d] for s, d in rows if s in layer and d in layer)


def test_cores_by_definition(both):
    rows, a = both
    core = table(a.kcore(), "id", "core")
    pairs = {frozenset(r) for r in rows if r[0] != r[1]}
    for k in range(1, max(core.values()) + 2):
        left = set(core)
        while True:
            drop = {v for v in left if sum(v in p and p <= left for p in pairs) < k}
            if not drop:
                break
            left -= drop
        assert left == {v for v, c in core.items() if c >= k}


def test_paths_leave_and_come_back(spark):
    rows = [(0, 1, 4.0), (0, 2, 1.0), (2, 1, 2.0), (1, 3, 5.0), (2, 3, 9.0), (3, 0, 1.0)]
    a = Algorithms(edges=spark.createDataFrame(rows, "src long, dst long, weight double"))
    assert a.dijkstra_path(0, 3, "weight") == (8.0, [0, 2, 1, 3]) == a.astar(0, 3, None, "weight")
    assert a.dijkstra_path(0, 77, "weight") is None
    assert {r["id"]: r["distance"] for r in iterative.sssp(a.weighted("weight"), 0).collect()} == {0: 0.0, 1: 3.0, 2: 1.0, 3: 8.0}


def test_components_of_long_paths_and_other_types(spark):
    rows = [("n%03d" % k, "n%03d" % (k + 1)) for k in range(100) if k % 50 != 49]
    edges = spark.createDataFrame(rows, "src string, dst string")
    for bound in (0, 1000):
        out = connected_components(edges, task_edges=bound).collect()
        assert {r["id"]: r["component"] for r in out} == {"n%03d" % k: "n%03d" % (k // 50 * 50) for k in range(100)}
    binary = edges.select(*[edges[c].cast("binary").alias(c) for c in edges.columns])
    assert {bytes(r["component"]) for r in connected_components(binary).collect()} == {b"n000", b"n050"}
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")).count() == 0


def test_bound_is_checked(spark, monkeypatch):
    monkeypatch.setattr(library, "LOCAL_EDGES", 2)
    a = Algorithms(edges=spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long"))
    assert not a.small and a.pagerank().count() == 3
    with pytest.raises(ValueError):
        a.bridges()


def test_betweenness_by_counting_paths(spark):
    rows = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (1, 2)]
    a = Algorithms(edges=spark.createDataFrame(rows, "src long, dst long"))
    near_of = {}
    for s, d in rows:
        near_of.setdefault(s, []).append(d)

    def paths(s, t):
        level = [[s]]
        while level:
            hit = [p for p in level if p[-1] == t]
            if hit:
                return hit
            level = [p + [d] for p in level for d in near_of.get(p[-1], ()) if d not in p]
        return []

    want = dict.fromkeys(range(6), 0.0)
    for s, t in itertools.permutations(range(6), 2):
        found = paths(s, t)
        for p in found:
            for v in p[1:-1]:
                want[v] += 1 / len(found)
    got = {r["id"]: r["score"] for r in a.betweenness_centrality(False).collect()}
    assert near(got, want)


def test_visitors():
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)]
    seen = []
    assert sequential.visit(edges, 1, lambda e: seen.append((e.kind, e.node, e.target))) is None
    assert [n for k, n, _ in seen if k == "discover"] == [1, 2, 3, 4] == [n for k, n, _ in seen if k == "finish"]
    assert [(a, b) for k, a, b in seen if k == "cross"] == [(3, 4), (4, 1)]
    seen.clear()
    sequential.visit(edges, 1, lambda e: seen.append((e.kind, e.node, e.target)), depth_first=True)
    assert [n for k, n, _ in seen if k == "finish"] == [4, 2, 3, 1] and ("back", 4, 1) in seen and ("cross", 3, 4) in seen
    assert sequential.visit(edges, 1, lambda e: sequential.Stop(e.node) if e == sequential.Event("discover", 3) else None) == 3
    pruned = []
    sequential.visit(edges, 1, lambda e: pruned.append(e.node) or sequential.PRUNE if e.kind == "discover" else None)
    assert pruned == [1]


def test_adapters(spark):
    from weftgraph.session import Database
    from weftgraph.sources.graph import PropertyGraph

    db = Database(spark, PropertyGraph.of_rows(spark, [(k, ["N"], {}) for k in range(4)], [(0, 1, "E", {"weight": 2.0}), (1, 2, "E", {"weight": 1.0}), (0, 2, "E", {"weight": 5.0})]))
    x = db.as_networkx()
    assert (x.number_of_nodes(), x.number_of_edges(), x.nodes(), x.edges()) == (4, 3, [0, 1, 2, 3], [(0, 1), (0, 2), (1, 2)])
    assert (x.neighbors(0), x.degree(1), x.in_degree(2), x.out_degree(2), x.has_edge(0, 1), x.has_edge(1, 0), x.has_node(9)) == ([1, 2], 2, 2, 0, True, False, False)
    assert db.as_networkx(False).neighbors(2) == [0, 1] and x.shortest_path(0, 2, "weight") == [0, 1, 2] and x.shortest_path_length(0, 2, "weight") == 3.0
    assert x.connected_components() == [[0, 1, 2], [3]] and set(x.pagerank()) == {0, 1, 2, 3}
    o = db.as_solvor()
    assert o.minimum_spanning_tree("weight")["total_weight"] == 3.0 and o.topological_sort() is not None
    assert o.all_pairs_shortest_paths("weight")[0, 2] == 3.0 and o.graph_stats()["edge_count"] == 3
    assert o.max_flow(0, 2, "weight")["max_flow"] == 6.0 and o.bridges() == [] and o.articulation_points() == []


def test_triangles_of_colours_chunks_and_hubs(spark, monkeypatch):
    from weftgraph.algo import packed

    rng = random.Random(3)
    rows = [(rng.randrange(40) * 10**12 - 5, rng.randrange(40) * 10**12 - 5) for _ in range(250)] + [(7, k) for k in range(100, 150)] + [(k + 1, k) for k in range(100, 150)]
    pairs = {frozenset(r) for r in rows if r[0] != r[1]}
    near = {v: {w for p in pairs if v in p for w in p} - {v} for v in set().union(*pairs)}
    want = sorted((a, b, c) for a in near for b in near[a] for c in near[a] & near[b] if a < b < c)
    for name, value in {"SMALL_EDGES": 10, "CHUNK_EDGES": 100, "WEDGES": 7, "TASK_EDGES": 200}.items():
        monkeypatch.setattr(packed, name, value)
    a = Algorithms(edges=spark.createDataFrame(rows, "src long, dst long"))
    assert sorted(map(tuple, a.triangles().collect())) == want and len(packed.hubs(packed.pairs(a.edges), len(pairs))[0]) > 0
    plan = a.triangles()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan, "pairs of arcs are rows of an exchange"
    assert Algorithms(edges=spark.createDataFrame([(1, 1)], "src long, dst long")).triangles().count() == 0


def test_thinned_blocks_against_depth_first_search(spark, monkeypatch):
    from weftgraph.algo import packed

    monkeypatch.setattr(packed, "ROW_EDGES", 9)
    rng = random.Random(11)
    for n, m in ((30, 28), (30, 40), (12, 40), (60, 75)):
        rows = [(rng.randrange(n) * 7 - 9, rng.randrange(n) * 7 - 9) for _ in range(m)]
        a = Algorithms(edges=spark.createDataFrame(rows, "src long, dst long").repartition(3))
        points, bridges = sequential.cut_parts(a.local_nodes(), rows)
        assert (a.articulation_points(), a.bridges()) == (sorted(points), sorted(bridges))


def test_more_edges_than_a_process_may_hold(spark, monkeypatch):
    """The bound on edges turns nothing away where nodes are few: a wheel has more edges than the bound allows."""
    rows = [(0, k) for k in range(1, 9)] + [(k, k % 8 + 1) for k in range(1, 9)] + [(20, 0), (20, 21)]
    monkeypatch.setattr(library, "LOCAL_EDGES", 12)
    a = Algorithms(edges=spark.createDataFrame(rows, "src long, dst long"))
    assert a.articulation_points() == [0, 20] and a.bridges() == [(0, 20), (20, 21)]


def test_shards_agree(both, monkeypatch):
    from weftgraph.algo import sharded

    rows, a = both
    monkeypatch.setattr(sharded, "SHARD_EDGES", 5)
    one, whole = a.topological_layers()
    many, same = sharded.layers(a.nodes, a.arcs)
    assert table(one, "id", "layer") == table(many, "id", "layer") and whole == same
    assert table(a.kcore(), "id", "core") == table(sharded.cores(a.nodes, a.arcs), "id", "core") == table(iterative.core_numbers(a.nodes, a.arcs), "id", "core")
    far = Algorithms(nodes=a.nodes, edges=a.edges)
    far.small = far.sharded = False
    assert table(far.topological_layers()[0], "id", "layer") == table(one, "id", "layer")


def test_louvain_above_the_bound(spark, monkeypatch):
    from weftgraph.algo import sharded

    cliques = [(10 * c + i, 10 * c + j) for c in range(5) for i, j in itertools.combinations(range(6), 2)]
    rows = cliques + [(10 * c, 10 * c + 10) for c in range(4)] + [(3, 3), (50, 50)]
    monkeypatch.setattr(library, "LOCAL_EDGES", 10)
    for most in (500, 0):
        monkeypatch.setattr(sharded, "DRIVER_EDGES", most)
        labels, score = Algorithms(nodes=spark.createDataFrame([(v,) for v in sorted({x for r in rows for x in r} | {99})], "id long"), edges=spark.createDataFrame(rows, "src long, dst long")).louvain()
        assert table(labels, "id", "label") == {**{10 * c + i: 10 * c for c in range(5) for i in range(6)}, 50: 50, 99: 99} and score > 0.6


def test_closeness_by_sources(both, monkeypatch):
    rows, a = both
    want = iterative.closeness(a.nodes, a.arcs, True)
    monkeypatch.setattr(iterative, "closeness", None)  # a row for each pair of nodes
    far = Algorithms(nodes=a.nodes, edges=a.edges)
    far.small = False
    assert near(table(far.closeness_centrality(True), "id", "score"), table(want, "id", "score"))


def test_louvain_holds_no_large_graph_in_the_driver(spark, monkeypatch):
    from weftgraph.algo import sharded

    def bounded(nodes, edges, resolution=1.0, find=sequential.louvain):
        assert len(edges) <= 30
        return find(nodes, edges, resolution)

    rows = [(10 * c + i, 10 * c + j) for c in range(5) for i, j in itertools.combinations(range(6), 2)] + [(10 * c, 10 * c + 10) for c in range(4)]
    monkeypatch.setattr(sharded, "DRIVER_EDGES", 30)
    monkeypatch.setattr(sequential, "louvain", bounded)
    a = Algorithms(edges=spark.createDataFrame(rows, "src long, dst long"))
    assert a.small
    assert table(a.louvain()[0], "id", "label") == {10 * c + i: 10 * c for c in range(5) for i in range(6)}


def test_betweenness_goes_over_the_edges_for_many_sources_at_once(monkeypatch):
    from weftgraph.algo import local

    rng = np.random.default_rng(5)
    n = 300
    a, b = rng.integers(0, n, 1500), rng.integers(0, n, 1500)
    a, b = np.r_[a, n - 1, n - 1, 7], np.r_[b, 3, 3, 7]  # edges that are there twice, a node's edge to itself
    looked = []
    monkeypatch.setattr(local, "edges_at", lambda *x, f=local.edges_at: looked.append(1) or f(*x))
    want = np.zeros(n)
    for s in range(n):
        depth, paths, order = {s: 0}, {s: 1.0}, [s]
        for u in order:
            for v in b[a == u].tolist():
                if v not in depth:
                    depth[v], paths[v] = depth[u] + 1, 0.0
                    order.append(v)
                if depth[v] == depth[u] + 1:
                    paths[v] += paths[u]
        share = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            for v in b[a == u].tolist():
                if depth[v] == depth[u] + 1:
                    share[u] += paths[u] / paths[v] * (1 + share[v])
            want[u] += share[u] if u != s else 0.0
    for single, together in ((16, 128), (0, 128), (10**9, 128), (16, 7)):
        monkeypatch.setattr(local, "SINGLE", single)
        monkeypatch.setattr(local, "TOGETHER", together)
        looked.clear()
        assert np.allclose(local.dependencies(a, b, n, np.arange(n)), want, rtol=1e-9)
        # three batches of sources, some levels each: not one look-up for each source and level
        assert together == 7 or len(looked) < n


def test_betweenness_of_several_components(spark, monkeypatch):
    from weftgraph.algo import local

    monkeypatch.setattr(local, "TOGETHER", 2)
    rows = [(10 * c + i, 10 * c + i + 1) for c in range(3) for i in range(5)] + [(7, 7), (50, 50)]
    a = Algorithms(edges=spark.createDataFrame(rows, "src long, dst long"))
    got = table(a.betweenness_centrality(False), "id", "score")
    assert near(got, {**{10 * c + i: i * (5 - i) * 1.0 for c in range(3) for i in range(6)}, 7: 0.0, 50: 0.0})


def test_betweenness_adds_counts_in_the_smallest_type_that_holds_them(monkeypatch):
    from weftgraph.algo import local

    wide, layers = 6, 16  # each node leads to all of the next layer: up to 6 ** 14 paths
    a, b = (np.array(x) for x in zip(*((wide * i + x, wide * (i + 1) + y) for i in range(layers - 1) for x in range(wide) for y in range(wide))))
    a, b = np.r_[a, [200] * 40], np.r_[b, np.arange(101, 141)]  # one with more edges than the others, not reached from layers
    want = np.zeros(201)
    want[: wide * layers] = np.repeat([i * (layers - 1 - i) * wide for i in range(layers)], wide)
    kinds = set()

    def seen(to, many, rows, of, f=local.added_rows):
        kinds.add(rows.dtype.name)
        assert len(rows) <= wide * layers  # not of the whole graph
        yield from f(to, many, rows, of)

    monkeypatch.setattr(local, "added_rows", seen)
    monkeypatch.setattr(local, "SINGLE", 10**9)
    for few, gathered in ((1, 1 << 16), (10**9, 1 << 16), (3, 64)):
        monkeypatch.setattr(local, "FEW", few)
        monkeypatch.setattr(local, "GATHERED", gathered)
        assert np.allclose(local.dependencies(a, b, 201, np.arange(201)), want, rtol=1e-12)
    assert kinds == {"uint16", "uint32", "float64"}


def test_closeness_and_betweenness_hold_no_more_than_a_component(spark, monkeypatch):
    from weftgraph.algo import local, parts

    rows = [(100 * c + i, 100 * c + i + 1) for c in range(7) for i in range(5)] + [(900 + i, 901 + i) for i in range(30)] + [(7000, 7001), (50000, 50000), (100, 101)]
    score = {}
    for first, n in [(100 * c, 6) for c in range(7)] + [(900, 31), (7000, 2)]:
        score |= {first + i: (2.0 / (n - i) if i < n - 1 else 0.0, float(i * (n - 1 - i))) for i in range(n)}
    score[50000] = (0.0, 0.0)
    score |= {100 + i: (score[100 + i][0], score[100 + i][1]) for i in range(6)}
    want = [{k: v[i] for k, v in score.items()} for i in range(2)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    monkeypatch.setattr(library, "LOCAL_EDGES", 10)
    monkeypatch.setattr(library, "cut", None)  # an edge for each row, in the shared folder
    monkeypatch.setattr(iterative, "closeness", None)  # a row for each pair of nodes
    monkeypatch.setattr(parts, "PART_EDGES", 31)
    monkeypatch.setattr(local, "TOGETHER", 4)
    for together, merged in ((10, 8), (1, 8), (1024, 1 << 20)):
        monkeypatch.setattr(parts, "TOGETHER_NODES", together)
        monkeypatch.setattr(parts, "MERGED_EDGES", merged)
        monkeypatch.setattr(parts, "PART_EDGES", 31 if together < 1024 else 100)
        a = Algorithms(edges=edges)
        assert not a.packed_arcs.isEmpty() and not a.small
        assert Algorithms(edges=edges).in_parts(30) is None
        held = Algorithms(edges=edges).in_parts(100).edges
        assert held.sum() == len(rows) and (held.max() == 30 or together == 1024)
        assert near(table(a.closeness_centrality(), "id", "score"), want[0])
        assert near(table(Algorithms(edges=edges).betweenness_centrality(False), "id", "score"), want[1])


def test_closeness_of_a_component_too_large_for_a_task(both, monkeypatch):
    from weftgraph.algo import parts

    rows, a = both
    want = table(a.closeness_centrality(), "id", "score")
    monkeypatch.setattr(library, "LOCAL_EDGES", 0)
    monkeypatch.setattr(parts, "PART_EDGES", 1)
    assert near(table(Algorithms(nodes=a.nodes, edges=a.edges).closeness_centrality(), "id", "score"), want)
