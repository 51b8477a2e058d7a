"""The algorithm library over a property graph, with the names and defaults that callers know."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import PropertyGraph
from ..plans.lineage import cut
from . import iterative, local, packed, parts, sequential, sharded
from .components import connected_components

#: Edges and nodes that one process may hold: the driver for an algorithm that is sequential by nature, a task for
#: one that has distributed rounds too and takes those above this bound. About 100 bytes each at the peak.
LOCAL_EDGES = 5_000_000

_REGISTRY: dict[str, Callable] = {}


def register_algorithm(name: str, fn: Callable) -> None:
    """Make ``fn(graph, **parameters)`` callable as ``Algorithms.run(name, ...)``."""
    _REGISTRY[name] = fn


class Algorithms:
    """``edges`` may be given in place of the graph's own, as ``src, dst`` and weights."""

    def __init__(self, graph: PropertyGraph | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None):
        self.graph = graph
        self.edges = edges if edges is not None else graph.scan_edges()
        self._listed = nodes.select("id").distinct() if nodes is not None else graph.scan_nodes().select("id") if graph is not None else None
        self._arcs: DataFrame | None = None

    @cached_property
    def nodes(self) -> DataFrame:
        return self._listed if self._listed is not None else iterative.nodes_of(self.arcs)

    @property
    def arcs(self) -> DataFrame:
        """``src, dst`` of all edges, worked out once however many rounds read them."""
        if self._arcs is None:
            self._arcs = cut(self.edges.select("src", "dst"))
        return self._arcs

    @cached_property
    def packed_arcs(self) -> DataFrame:
        """The edges, many in a row; if nothing has read :attr:`arcs` yet, these are read from here."""
        rows = parts.arcs(self.edges)
        if self._arcs is None:
            self._arcs = parts.unpacked(rows)
        return rows

    def in_parts(self, most: int) -> parts.Parts | None:
        """The graph by components; None if more than ``most`` nodes have edges. Nodes that are not listed are taken from
        there."""
        found = parts.components(self.packed_arcs, most)
        if found is None:
            return None
        if self._listed is None and "nodes" not in self.__dict__:
            self.nodes = self.edges.sparkSession.createDataFrame(pa.table({"id": found[0]}), "id bigint")
        return parts.Parts(self.packed_arcs, *found)

    @cached_property
    def small(self) -> bool:
        """Whether one task may hold the graph."""
        n = self.packed_arcs.agg(F.sum("n")).first()[0] or 0 if "packed_arcs" in self.__dict__ else self.arcs.count()
        return n <= LOCAL_EDGES and (self._listed is None or n + self._listed.count() <= LOCAL_EDGES)

    @cached_property
    def sharded(self) -> bool:
        """Whether arrays of the driver may hold a few numbers for each node."""
        return self.nodes.count() <= sharded.NODES

    def in_one_task(self, work: Callable, schema: str) -> DataFrame:
        return local.in_one_task(self.arcs, self._listed, work, schema)

    def weighted(self, weight: str | None, name: str = "weight", default: float = 1.0) -> DataFrame:
        value = F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(default)) if weight and weight in self.edges.columns else F.lit(default)
        return self.edges.select("src", "dst", value.alias(name))

    def local(self, *columns: DataFrame) -> list[tuple]:
        df = columns[0]
        if df.count() > LOCAL_EDGES:
            raise ValueError(f"the graph has more than {LOCAL_EDGES} edges; this algorithm runs in one process")
        return [tuple(r) for r in df.collect()]

    def local_nodes(self) -> list[int]:
        return [r[0] for r in self.local(self.nodes)]

    def run(self, name: str, **parameters):
        if name in _REGISTRY:
            return _REGISTRY[name](self.graph, **parameters)
        return getattr(self, name)(**parameters)

    # traversal
    def bfs(self, start: int) -> DataFrame:
        if self.small:
            return self.in_one_task(lambda *g: local.bfs(*g, start), "id long, depth long")
        return iterative.bfs(self.arcs, start)

    def bfs_layers(self, start: int) -> DataFrame:
        return self.bfs(start).groupBy("depth").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def dfs(self, start: int) -> list[int]:
        return sequential.dfs(self.local(self.edges.select("src", "dst")), start)

    def dfs_all(self) -> list[int]:
        return sequential.dfs_all(self.local_nodes(), self.local(self.edges.select("src", "dst")))

    def visit(self, start: int, visitor: Callable, depth_first: bool = False):
        """Tell ``visitor`` every event of a breadth-first or depth-first walk; see :func:`.sequential.visit`."""
        if self.nodes.where(F.col("id") == start).isEmpty():
            return None
        return sequential.visit(self.local(self.edges.select("src", "dst")), start, visitor, depth_first)

    # components
    def connected_components(self) -> DataFrame:
        if self.small:
            return self.in_one_task(local.components, "id long, component long")
        found = connected_components(self.arcs, task_edges=0)
        return self.nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))

    def connected_component_count(self) -> int:
        return self.connected_components().select("component").distinct().count()

    def strongly_connected_components(self) -> DataFrame:
        return iterative.strong_components(self.nodes, self.edges)

    def topological_layers(self) -> tuple[DataFrame, bool]:
        """``id, layer`` of the nodes that no cycle holds back, and whether these are all."""
        if self.small:
            found = cut(self.in_one_task(local.layers, "id long, layer long"))
            return found.where("layer >= 0"), found.where("layer < 0").isEmpty()
        if self.sharded:
            return sharded.layers(self.nodes, self.arcs)
        return iterative.topological_layers(self.nodes, self.arcs)

    def topological_sort(self) -> DataFrame | None:
        layers, acyclic = self.topological_layers()
        return layers.orderBy("layer", "id") if acyclic else None

    def is_dag(self) -> bool:
        return self.topological_layers()[1]

    # shortest paths
    def dijkstra(self, source: int, target: int | None = None, weight: str | None = None) -> DataFrame:
        """``id, distance, predecessor``; with a target its row alone."""
        edges = self.weighted(weight)
        if not edges.where("weight < 0").isEmpty():
            raise ValueError("weights must not be negative; use bellman_ford")
        out = iterative.sssp(edges, source)
        return out if target is None else out.where(F.col("id") == target)

    def dijkstra_path(self, source: int, target: int, weight: str | None = None) -> tuple[float, list[int]] | None:
        """Distance and path: the predecessors that the distributed search leaves are walked back."""
        found = cut(self.dijkstra(source, None, weight))
        path, at = [], found.where(F.col("id") == target).first()
        if at is None:
            return None
        distance = at["distance"]
        while at is not None:
            path.append(at["id"])
            at = None if at["id"] == source else found.where(F.col("id") == at["predecessor"]).first()
        return distance, path[::-1]

    def astar(self, source: int, target: int, heuristic=None, weight: str | None = None) -> tuple[float, list[int]] | None:
        guess = heuristic if callable(heuristic) else (lambda v: (heuristic or {}).get(v, 0.0))
        return sequential.astar(self.local(self.weighted(weight)), source, target, guess)

    def bellman_ford(self, source: int, weight: str | None = None) -> tuple[DataFrame, bool]:
        return iterative.bellman_ford(self.weighted(weight), source)

    def floyd_warshall(self, weight: str | None = None) -> DataFrame:
        return iterative.floyd_warshall(self.weighted(weight))

    # centrality
    def degree_centrality(self, normalized: bool = False) -> DataFrame:
        return iterative.degrees(self.nodes, self.edges, normalized)

    def pagerank(self, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
        if self.small:
            return self.in_one_task(lambda *g: local.pagerank(*g, damping, max_iterations, tolerance), "id long, score double")
        return iterative.pagerank(self.nodes, self.arcs, damping, max_iterations, tolerance)

    def betweenness_centrality(self, normalized: bool = True) -> DataFrame:
        found = self.in_parts(parts.NODES)
        if found is None or found.edges.max(initial=0) > parts.PART_EDGES:
            raise ValueError(f"more than {parts.NODES} nodes, or {parts.PART_EDGES} edges of one component, which a task would have to hold")
        return iterative.betweenness(self.nodes, found, normalized)

    def closeness_centrality(self, wf_improved: bool = False) -> DataFrame:
        self.packed_arcs  # noqa: B018 a large graph is too much for :attr:`arcs` as rows
        if self.small:
            return self.in_one_task(lambda *g: local.closeness(*g, wf_improved), "id long, score double")
        found = self.in_parts(sharded.NODES)
        if found is not None and found.edges.max(initial=0) <= parts.PART_EDGES:
            return iterative.closeness_by_parts(self.nodes, found, wf_improved)
        return iterative.closeness(self.nodes, self.arcs, wf_improved)

    # communities
    def label_propagation(self, max_iterations: int = 100) -> DataFrame:
        if self.small:
            return self.in_one_task(lambda *g: local.labels(*g, max_iterations or 100), "id long, label long")
        return iterative.label_propagation(self.nodes, self.arcs, max_iterations or 100)

    def louvain(self, resolution: float = 1.0) -> tuple[DataFrame, float]:
        # the driver takes many times the bytes of an edge for it, so its bound is far below that of a task
        if self.small and self.arcs.count() + self.nodes.count() <= sharded.DRIVER_EDGES:
            found = sequential.louvain(self.local_nodes(), self.local(self.arcs), resolution)
            labels = self.nodes.sparkSession.createDataFrame(sorted(found.items()), "id bigint, label bigint")
        else:
            labels = sharded.louvain(self.nodes, self.arcs, resolution)
        return labels, self.modularity(labels, resolution)

    def modularity(self, labels: DataFrame, resolution: float = 1.0) -> float:
        return iterative.modularity(self.arcs, labels, resolution)

    # trees and flows
    def kruskal(self, weight: str | None = None) -> DataFrame:
        return iterative.spanning_forest(self.weighted(weight))

    def prim(self, weight: str | None = None, start: int | None = None) -> list[tuple]:
        return sequential.prim(self.local_nodes(), self.local(self.weighted(weight)), start)

    def max_flow(self, source: int, sink: int, capacity: str | None = None) -> tuple[float, dict]:
        return sequential.max_flow(self.local(self.weighted(capacity, "capacity")), source, sink)

    def min_cost_max_flow(self, source: int, sink: int, capacity: str | None = None, cost: str | None = None) -> tuple[float, float]:
        def value(c, default):
            return F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(default)) if c and c in self.edges.columns else F.lit(default)

        return sequential.min_cost_max_flow(self.local(self.edges.select("src", "dst", value(capacity, 1.0), value(cost, 0.0))), source, sink)

    # structure
    @cached_property
    def cut_parts(self) -> DataFrame:
        """``src, dst``: bridges, smaller id first, and articulation points with a null ``dst``."""
        found = cut(local.blocks_of_packed(packed.pairs(self.edges), LOCAL_EDGES))
        if not found.where("src is null").isEmpty():
            raise ValueError(f"the graph has more than {LOCAL_EDGES} nodes; this algorithm ends in one process")
        return found

    def cut_nodes(self) -> DataFrame:
        return self.cut_parts.where("dst is null").select(F.col("src").alias("id"))

    def cut_edges(self) -> DataFrame:
        return self.cut_parts.where("dst is not null")

    def articulation_points(self) -> list[int]:
        return sorted(r[0] for r in self.cut_nodes().collect())

    def bridges(self) -> list[tuple[int, int]]:
        return sorted((r[0], r[1]) for r in self.cut_edges().collect())

    def kcore(self, k: int | None = None) -> DataFrame:
        """``id, core``; with ``k`` only nodes of the k-core."""
        if self.small:
            out = self.in_one_task(local.cores, "id long, core long")
        else:
            out = (sharded.cores if self.sharded else iterative.core_numbers)(self.nodes, self.arcs)
        return out if k is None else out.where(F.col("core") >= k)

    def k_shell(self, k: int) -> DataFrame:
        return self.kcore().where(F.col("core") == k)

    def triangles(self) -> DataFrame:
        return packed.triangles(self.edges)

    # names that operations-research callers use
    def shortest_path(self, source: int, target: int, weight: str | None = None):
        return self.dijkstra_path(source, target, weight)

    def minimum_spanning_tree(self, weight: str | None = None) -> DataFrame:
        return self.kruskal(weight)

    # exchange with NetworkX, where it is installed
    def to_networkx(self, directed: bool = True):
        import networkx as nx

        g = (nx.MultiDiGraph if directed else nx.MultiGraph)()
        g.add_nodes_from(self.local_nodes())
        columns = self.edges.columns
        for row in self.local(self.edges):
            r = dict(zip(columns, row))
            g.add_edge(r.pop("src"), r.pop("dst"), **{c: v for c, v in r.items() if v is not None})
        return g
