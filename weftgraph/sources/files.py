"""Graphs from and to files that Spark reads: Parquet, JSON, CSV, ORC; and edge lists of other libraries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import PropertyGraph


def _read(graph: PropertyGraph, path: str, format: str, schema: str | None, options: dict) -> DataFrame:
    reader = graph.spark.read.format(format).options(**({"header": "true", "inferSchema": str(schema is None).lower()} if format == "csv" else {}), **options)
    return (reader.schema(schema) if schema else reader).load(path)


def load_nodes(graph: PropertyGraph, path: str, labels: Iterable[str], id: str = "id", format: str = "parquet", schema: str | None = None, **options: str) -> PropertyGraph:
    """Add nodes from files; column ``id`` holds their ids, the others are properties."""
    df = _read(graph, path, format, schema, options)
    return graph.add_nodes(df.select(F.col(id).cast("bigint").alias("id"), *[c for c in df.columns if c != id]), labels)


def load_edges(graph: PropertyGraph, path: str, type: str, src: str = "src", dst: str = "dst", format: str = "parquet", schema: str | None = None, from_labels: Iterable[str] = (), to_labels: Iterable[str] = (), **options: str) -> PropertyGraph:
    """Add edges of one type from files; other columns are properties."""
    df = _read(graph, path, format, schema, options)
    ends = [F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst")]
    return graph.add_edges(df.select(*ends, *[c for c in df.columns if c not in (src, dst)]), type, from_labels, to_labels)


def dump(graph: PropertyGraph, path: str, format: str = "parquet") -> None:
    """Every frame as a folder ``nodes/<labels>-<k>`` or ``edges/<type>-<k>``; list properties do not fit CSV."""
    for k, f in enumerate(graph.nodes):
        name = "+".join(sorted(f.labels)) or "none"
        f.df.write.format(format).mode("overwrite").options(**({"header": "true"} if format == "csv" else {})).save(f"{path}/nodes/{name}-{k}")
    for k, f in enumerate(graph.edges):
        f.df.write.format(format).mode("overwrite").options(**({"header": "true"} if format == "csv" else {})).save(f"{path}/edges/{f.type}-{k}")


def from_networkx(spark, g, label: str = "Node", type: str = "EDGE") -> PropertyGraph:
    """A graph of another library with ``nodes(data=True)`` and ``edges(data=True)``; nodes are numbered in order
    and keep their name as property ``name`` where it is no whole number."""
    place = {n: k for k, n in enumerate(g.nodes())}
    whole = all(isinstance(n, int) for n in place)
    number = (lambda n: n) if whole else place.__getitem__
    nodes = [(number(n), [label], dict(d) if whole else {"name": str(n), **d}) for n, d in g.nodes(data=True)]
    edges = [(number(a), number(b), type, dict(d)) for a, b, d in g.edges(data=True)]
    if not g.is_directed():
        edges += [(b, a, t, d) for a, b, t, d in edges]
    return PropertyGraph.of_rows(spark, nodes, edges)
