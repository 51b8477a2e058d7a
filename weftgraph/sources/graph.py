"""The property-graph model: typed DataFrames for nodes and edges."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NodeFrame:
    """Nodes that all have ``labels``: ``id BIGINT`` and properties. With ``dynamic`` a column ``labels`` holds
    each node's own labels, and ``labels`` here lists those that may occur."""

    labels: frozenset[str]
    df: DataFrame
    dynamic: bool = False

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("id", "labels")]


@dataclass(frozen=True)
class EdgeFrame:
    """Edges of one type: ``src, dst BIGINT`` and properties, ``id`` where edges have ids of their own.
    ``from_labels`` and ``to_labels`` name a label that every source or target has, where that is known;
    ``unique`` says that no two rows are equal."""

    type: str
    df: DataFrame
    from_labels: frozenset[str] = frozenset()
    to_labels: frozenset[str] = frozenset()
    unique: bool = False

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("id", "src", "dst")]

    def with_id(self) -> DataFrame:
        """Edges with an id: their own, or a hash of the whole row. Equal rows are numbered first, so that parallel
        edges without any property to tell them apart are edges of their own; ``unique`` rows need no number."""
        if "id" in self.df.columns:
            return self.df
        columns = [F.col(f"`{c}`") for c in self.df.columns]
        if self.unique:
            return self.df.withColumn("id", F.xxhash64(F.lit(self.type), *columns))
        nth = F.row_number().over(Window.partitionBy(*columns).orderBy(F.lit(0)))
        return self.df.withColumn("_nth", nth).withColumn("id", F.xxhash64(F.lit(self.type), "_nth", *columns)).drop("_nth")


@dataclass(frozen=True)
class PropertyGraph:
    spark: SparkSession
    nodes: tuple[NodeFrame, ...] = ()
    edges: tuple[EdgeFrame, ...] = ()
    constraints: dict = field(default_factory=dict, compare=False)

    # -- schema -------------------------------------------------------------------------------------

    def labels(self) -> list[str]:
        return sorted({x for f in self.nodes for x in f.labels})

    def edge_types(self) -> list[str]:
        return sorted({f.type for f in self.edges})

    def schema(self) -> dict:
        return {
            "labels": {x: sorted({p for f in self.nodes if x in f.labels for p in f.properties}) for x in self.labels()},
            "edge_types": {t: sorted({p for f in self.edges if f.type == t for p in f.properties}) for t in self.edge_types()},
        }

    # -- scans --------------------------------------------------------------------------------------

    def node_frames(self, labels: Iterable[str] = (), within: frozenset[str] = frozenset()) -> list[NodeFrame]:
        """Frames that may hold nodes with all of ``labels``; ``within``: one label that they are known to have."""
        wanted = [*labels, *within]
        return [f for f in self.nodes if all(x in f.labels for x in wanted)]

    def scan_nodes(self, labels: Iterable[str] = (), within: frozenset[str] = frozenset()) -> DataFrame:
        """Nodes with all of ``labels``: id, labels and the properties of every frame, null where one lacks it."""
        labels, out = list(labels), []
        for f in self.node_frames(labels, within):
            df = f.df
            if f.dynamic:
                for x in labels:
                    df = df.where(F.array_contains("labels", x))
            else:
                df = df.withColumn("labels", F.array(*[F.lit(x) for x in sorted(f.labels)]))
            out.append(df)
        if not out:
            return self.spark.createDataFrame([], "id bigint, labels array<string>")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)

    def edge_frames(self, types: Iterable[str] = ()) -> list[EdgeFrame]:
        types = list(types)
        return [f for f in self.edges if not types or f.type in types]

    def scan_edges(self, types: Iterable[str] = (), with_id: bool = False) -> DataFrame:
        """``src, dst, type`` and properties of the edges of any of ``types``; all edges where none is given."""
        out = [(f.with_id() if with_id else f.df.drop("id")).withColumn("type", F.lit(f.type)) for f in self.edge_frames(types)]
        if not out:
            return self.spark.createDataFrame([], "src bigint, dst bigint, type string" + (", id bigint" if with_id else ""))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)

    # -- building -----------------------------------------------------------------------------------

    def add_nodes(self, df: DataFrame, labels: Iterable[str], dynamic: bool = False) -> PropertyGraph:
        return replace(self, nodes=(*self.nodes, NodeFrame(frozenset(labels), df, dynamic)))

    def add_edges(self, df: DataFrame, type: str, from_labels: Iterable[str] = (), to_labels: Iterable[str] = (), unique: bool = False) -> PropertyGraph:
        return replace(self, edges=(*self.edges, EdgeFrame(type, df, frozenset(from_labels), frozenset(to_labels), unique)))

    @staticmethod
    def of_rows(spark: SparkSession, nodes: list[tuple[int, list[str], dict]], edges: list[tuple[int, int, str, dict]]) -> PropertyGraph:
        """A small graph from Python rows; nodes are grouped by their labels, edges by type."""
        graph = PropertyGraph(spark)
        by_labels: dict[tuple, list] = {}
        for i, labels, props in nodes:
            by_labels.setdefault(tuple(sorted(labels)), []).append({"id": i, **props})
        for labels, rows in by_labels.items():
            graph = graph.add_nodes(frame(spark, rows, ["id"]), labels)
        by_type: dict[str, list] = {}
        for k, (s, d, t, props) in enumerate(edges):
            by_type.setdefault(t, []).append({"id": k, "src": s, "dst": d, **props})
        for t, rows in by_type.items():
            graph = graph.add_edges(frame(spark, rows, ["id", "src", "dst"]), t)
        return graph

    # -- persistence ----------------------------------------------------------------------------------

    def save(self, path: str) -> None:
        """A snapshot: one Parquet folder per frame in a folder of its own, then the manifest's rows for it.

        Earlier snapshots stay, so a graph that was opened from ``path`` can be changed and saved there again;
        a reader sees the snapshot before until the manifest has the new one.
        """
        version = max([0, *(r["version"] for r in manifest(self.spark, path))]) + 1
        own = f"v{version}-{uuid.uuid4().hex[:8]}"
        rows = []
        for k, f in enumerate(self.nodes):
            f.df.write.parquet(f"{path}/{own}/nodes-{k:04d}")
            rows.append((version, "node", f"{own}/nodes-{k:04d}", sorted(f.labels), f.dynamic, [], [], False))
        for k, f in enumerate(self.edges):
            f.df.write.parquet(f"{path}/{own}/edges-{k:04d}")
            rows.append((version, "edge", f"{own}/edges-{k:04d}", [f.type], False, sorted(f.from_labels), sorted(f.to_labels), f.unique))
        if not rows:
            rows = [(version, "none", "", [], False, [], [], False)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")

    @staticmethod
    def open(spark: SparkSession, path: str) -> PropertyGraph:
        graph, rows = PropertyGraph(spark), manifest(spark, path)
        if not rows:
            raise FileNotFoundError(f"no graph at {path}")
        last = max(r["version"] for r in rows)
        for r in sorted((r for r in rows if r["version"] == last and r["kind"] != "none"), key=lambda r: r["folder"]):
            df = spark.read.parquet(f"{path}/{r['folder']}")
            graph = graph.add_nodes(df, r["names"], r["dynamic"]) if r["kind"] == "node" else graph.add_edges(df, r["names"][0], r["from_labels"] or (), r["to_labels"] or (), bool(r["unique"]))
        return graph


MANIFEST = "version int, kind string, folder string, names array<string>, dynamic boolean, from_labels array<string>, to_labels array<string>, unique boolean"


def manifest(spark: SparkSession, path: str) -> list:
    """Rows of all snapshots at a path; none where nothing was saved."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()
    except AnalysisException:
        return []


_KINDS = {bool: "boolean", int: "bigint", float: "double", str: "string", bytes: "binary"}


def kind_of(value) -> str:
    """Spark's type for a Python property value."""
    if isinstance(value, list):
        return f"array<{kind_of(next((x for x in value if x is not None), ''))}>"
    if isinstance(value, dict):
        return "map<string,string>"
    return _KINDS.get(type(value), "string")


def frame(spark: SparkSession, rows: list[dict], ids: list[str]) -> DataFrame:
    """A DataFrame of property rows; ints are BIGINT, a column of ints and floats is DOUBLE."""
    kinds = {i: "bigint" for i in ids}
    for r in rows:
        for k, v in r.items():
            if v is not None and k not in ids:
                kind = kind_of(v)
                kinds[k] = kind if kinds.get(k, kind) == kind else "double" if {kinds[k], kind} == {"bigint", "double"} else "string"
            kinds.setdefault(k, None)
    cast = {"double": float, "string": lambda x: x if isinstance(x, str) else str(x)}
    kinds = {k: v or "string" for k, v in kinds.items()}
    data = [tuple(None if r.get(k) is None else cast.get(v, lambda x: x)(r[k]) for k, v in kinds.items()) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{k}` {v}" for k, v in kinds.items()))
