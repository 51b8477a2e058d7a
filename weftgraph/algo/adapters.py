"""Views of a graph for callers of other libraries: NetworkX calls and operations-research names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .library import Algorithms


def as_dict(df: DataFrame, value: str) -> dict[int, float]:
    return {r["id"]: r[value] for r in df.collect()}


class NetworkXAdapter:
    """Degrees, neighbours and membership as single look-ups; whole measures as dictionaries.

    Each look-up is a small Spark job, so code that asks about every node should take the DataFrame of
    :class:`.library.Algorithms` instead. ``directed`` tells whether an edge can be walked one way only.
    """

    def __init__(self, algorithms: Algorithms, directed: bool = True):
        self.algorithms, self.directed = algorithms, directed
        out = algorithms.edges.select("src", "dst")
        self._arcs = out if directed else out.unionAll(out.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def is_directed(self) -> bool:
        return self.directed

    def number_of_nodes(self) -> int:
        return self.algorithms.nodes.count()

    def number_of_edges(self) -> int:
        return self.algorithms.edges.count()

    def nodes(self) -> list[int]:
        return sorted(self.algorithms.local_nodes())

    def edges(self) -> list[tuple[int, int]]:
        return sorted(self.algorithms.local(self.algorithms.edges.select("src", "dst")))

    def has_node(self, node: int) -> bool:
        return not self.algorithms.nodes.where(F.col("id") == node).isEmpty()

    def has_edge(self, a: int, b: int) -> bool:
        return not self._arcs.where((F.col("src") == a) & (F.col("dst") == b)).isEmpty()

    def neighbors(self, node: int) -> list[int]:
        return sorted(r["dst"] for r in self._arcs.where(F.col("src") == node).select("dst").distinct().collect())

    def in_degree(self, node: int) -> int:
        return self._arcs.where(F.col("dst") == node).count()

    def out_degree(self, node: int) -> int:
        return self._arcs.where(F.col("src") == node).count()

    def degree(self, node: int) -> int:
        return self.in_degree(node) + self.out_degree(node) if self.directed else self.out_degree(node)

    def pagerank(self, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6) -> dict[int, float]:
        return as_dict(self.algorithms.pagerank(alpha, max_iter, tol), "score")

    def betweenness_centrality(self, normalized: bool = True) -> dict[int, float]:
        return as_dict(self.algorithms.betweenness_centrality(normalized), "score")

    def closeness_centrality(self, wf_improved: bool = False) -> dict[int, float]:
        return as_dict(self.algorithms.closeness_centrality(wf_improved), "score")

    def connected_components(self) -> list[list[int]]:
        groups: dict[int, list[int]] = {}
        for node, c in sorted(as_dict(self.algorithms.connected_components(), "component").items()):
            groups.setdefault(c, []).append(node)
        return list(groups.values())

    def shortest_path(self, source: int, target: int, weight: str | None = None) -> list[int] | None:
        found = self.algorithms.dijkstra_path(source, target, weight)
        return found and found[1]

    def shortest_path_length(self, source: int, target: int, weight: str | None = None) -> float | None:
        found = self.algorithms.dijkstra_path(source, target, weight)
        return found and found[0]

    def to_networkx(self):
        return self.algorithms.to_networkx(self.directed)


class SolvorAdapter:
    """The library under the names that operations-research callers use."""

    def __init__(self, algorithms: Algorithms):
        self.algorithms = algorithms

    def shortest_path(self, source: int, target: int, weight: str | None = None) -> tuple[float, list[int]] | None:
        return self.algorithms.dijkstra_path(source, target, weight)

    def all_pairs_shortest_paths(self, weight: str | None = None) -> dict[tuple[int, int], float]:
        return {(r["src"], r["dst"]): r["distance"] for r in self.algorithms.floyd_warshall(weight).collect()}

    def max_flow(self, source: int, sink: int, capacity: str | None = None) -> dict:
        value, flows = self.algorithms.max_flow(source, sink, capacity)
        return {"max_flow": value, "flow_edges": flows}

    def min_cost_max_flow(self, source: int, sink: int, capacity: str | None = None, cost: str | None = None) -> dict:
        value, spent = self.algorithms.min_cost_max_flow(source, sink, capacity, cost)
        return {"max_flow": value, "total_cost": spent}

    def minimum_spanning_tree(self, weight: str | None = None) -> dict:
        rows = self.algorithms.kruskal(weight).collect()
        return {"total_weight": sum(r["weight"] for r in rows), "edges": sorted((r["src"], r["dst"], r["weight"]) for r in rows)}

    def connected_components(self) -> dict[int, int]:
        return as_dict(self.algorithms.connected_components(), "component")

    def strongly_connected_components(self) -> dict[int, int]:
        return as_dict(self.algorithms.strongly_connected_components(), "component")

    def topological_sort(self) -> list[int] | None:
        found = self.algorithms.topological_sort()
        return None if found is None else [r["id"] for r in found.collect()]

    def pagerank(self, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6) -> dict[int, float]:
        return as_dict(self.algorithms.pagerank(damping, max_iter, tol), "score")

    def betweenness_centrality(self, normalized: bool = True) -> dict[int, float]:
        return as_dict(self.algorithms.betweenness_centrality(normalized), "score")

    def louvain(self, resolution: float = 1.0) -> dict:
        labels, q = self.algorithms.louvain(resolution)
        return {"communities": as_dict(labels, "label"), "modularity": q}

    def articulation_points(self) -> list[int]:
        return self.algorithms.articulation_points()

    def bridges(self) -> list[tuple[int, int]]:
        return self.algorithms.bridges()

    def graph_stats(self) -> dict:
        n, m = self.algorithms.nodes.count(), self.algorithms.edges.count()
        return {"node_count": n, "edge_count": m, "density": m / (n * (n - 1)) if n > 1 else 0.0}
