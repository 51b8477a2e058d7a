"""The database facade: queries in five languages, direct updates, transactions and snapshots."""

from __future__ import annotations

import asyncio
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import QueryError
from .operators import mutations
from .plans import ir
from .plans.lineage import cut
from .plans.lower import Lowering
from .sources.graph import PropertyGraph
from .sources.rdf import TripleStore


@lru_cache(maxsize=512)
def parsed(text: str, language: str) -> ir.Operator:
    """The plan of a query text; frozen, so it can be shared."""
    if language in ("gql", "cypher"):
        from .lang.cypher import parse

        return parse(text, language == "gql")
    raise QueryError(f"unknown language {language}")


class Database:
    """A property graph and a triple store.

    DataFrames are immutable, so an update replaces the current graph by a new one and a transaction is the
    graph that was current when it began. ``max_hops`` bounds open variable-length patterns.
    """

    def __init__(self, spark: SparkSession, graph: PropertyGraph | None = None, triples: TripleStore | None = None, *, max_hops: int = 10, walks: bool = False):
        self.spark, self.max_hops, self.walks = spark, max_hops, walks
        self.graph = graph or PropertyGraph(spark)
        self.triples = triples or TripleStore.empty(spark)
        self._held: list[tuple[PropertyGraph, TripleStore]] = []
        self._path: str | None = None

    # -- queries -----------------------------------------------------------------------------------------

    def _lowering(self, params: dict | None) -> Lowering:
        return Lowering(self.graph, params, self.max_hops, self.walks)

    def _run(self, plan: ir.Operator, params: dict | None) -> DataFrame:
        if any(isinstance(x, ir.WRITES) for x in ir.walk(plan)):
            self.graph, out = mutations.run(self._lowering(params), plan)
            return out
        return self._lowering(params).run(plan)

    def execute(self, query: str, params: dict | None = None) -> DataFrame:
        """GQL."""
        return self._run(parsed(query, "gql"), params)

    def execute_cypher(self, query: str, params: dict | None = None) -> DataFrame:
        return self._run(parsed(query, "cypher"), params)

    def execute_gremlin(self, query: str, params: dict | None = None) -> DataFrame:
        from .lang import gremlin

        return gremlin.execute(self, query, params)

    def execute_graphql(self, query: str, params: dict | None = None) -> DataFrame:
        from .lang import graphql

        return graphql.execute(self, query, params)

    def execute_graphql_rdf(self, query: str, params: dict | None = None, namespace: str = "http://example.org/") -> DataFrame:
        from .lang import graphql

        return graphql.execute_rdf(self, query, params, namespace)

    def execute_sparql(self, query: str, params: dict | None = None) -> DataFrame:
        from .lang import sparql

        self.triples, out = sparql.execute(self.spark, self.triples, query, params)
        return out

    def query(self, text: str) -> Query:
        """A GQL query whose parameters are given one by one."""
        return Query(self, text)

    async def execute_async(self, query: str, params: dict | None = None) -> list:
        """Rows of a GQL query; the event loop goes on while Spark works."""
        return await asyncio.to_thread(lambda: self.execute(query, params).collect())

    # -- direct updates ------------------------------------------------------------------------------------

    def create_node(self, labels: list[str], properties: dict | None = None) -> int:
        self.graph, new = mutations.add_node(self.graph, labels, properties or {})
        return new

    def create_edge(self, source: int, target: int, edge_type: str, properties: dict | None = None) -> int:
        self.graph, new = mutations.add_edge(self.graph, source, target, edge_type, properties or {})
        return new

    def get_node(self, node_id: int) -> dict | None:
        row = self.graph.scan_nodes().where(F.col("id") == node_id).first()
        return None if row is None else {"id": row["id"], "labels": sorted(row["labels"]), "properties": {k: v for k, v in row.asDict().items() if k not in ("id", "labels") and v is not None}}

    def get_edge(self, edge_id: int) -> dict | None:
        row = self.graph.scan_edges(with_id=True).where(F.col("id") == edge_id).first()
        return None if row is None else {k: row[k] for k in ("id", "src", "dst", "type")} | {"properties": {k: v for k, v in row.asDict().items() if k not in ("id", "src", "dst", "type") and v is not None}}

    def delete_node(self, node_id: int, detach: bool = True) -> None:
        self.graph = mutations.delete_nodes(self.graph, self.spark.createDataFrame([(node_id,)], "id bigint"), detach)

    def delete_edge(self, edge_id: int) -> None:
        self.graph = mutations.delete_edges(self.graph, self.spark.createDataFrame([(edge_id,)], "id bigint"))

    def set_node_property(self, node_id: int, key: str, value) -> None:
        rows = self.spark.createDataFrame([(node_id,)], "id bigint").withColumn("value", F.lit(value))
        self.graph = mutations.set_property(self.graph, "node", rows, key)

    def remove_node_property(self, node_id: int, key: str) -> bool:
        """Whether the node had the property."""
        had = key in (self.get_node(node_id) or {"properties": {}})["properties"]
        if had:
            self.set_node_property(node_id, key, None)
        return had

    def set_edge_property(self, edge_id: int, key: str, value) -> None:
        rows = self.spark.createDataFrame([(edge_id,)], "id bigint").withColumn("value", F.lit(value))
        self.graph = mutations.set_property(self.graph, "edge", rows, key)

    def remove_edge_property(self, edge_id: int, key: str) -> bool:
        """Whether the edge had the property."""
        had = key in (self.get_edge(edge_id) or {"properties": {}})["properties"]
        if had:
            self.set_edge_property(edge_id, key, None)
        return had

    def get_node_labels(self, node_id: int) -> list[str] | None:
        found = self.get_node(node_id)
        return None if found is None else found["labels"]

    def add_node_label(self, node_id: int, label: str) -> None:
        self.graph = mutations.set_labels(self.graph, self.spark.createDataFrame([(node_id,)], "id bigint"), [label], False)

    def remove_node_label(self, node_id: int, label: str) -> None:
        self.graph = mutations.set_labels(self.graph, self.spark.createDataFrame([(node_id,)], "id bigint"), [label], True)

    def iter_nodes(self) -> DataFrame:
        return self.graph.scan_nodes()

    def iter_edges(self) -> DataFrame:
        return self.graph.scan_edges(with_id=True)

    # -- transactions --------------------------------------------------------------------------------------

    def begin(self) -> None:
        self._held.append((self.graph, self.triples))

    def commit(self) -> None:
        if not self._held:
            raise QueryError("no transaction")
        self._held.pop()

    def rollback(self) -> None:
        if not self._held:
            raise QueryError("no transaction")
        self.graph, self.triples = self._held.pop()

    def begin_transaction(self) -> Database:
        """For ``with``: commits at the end, rolls back on an error."""
        return self

    def __enter__(self) -> Database:
        self.begin()
        return self

    def __exit__(self, kind, value, trace) -> None:
        self.rollback() if kind else self.commit()

    # -- facts -----------------------------------------------------------------------------------------------

    @property
    def node_count(self) -> int:
        return sum(f.df.count() for f in self.graph.nodes)

    @property
    def edge_count(self) -> int:
        return sum(f.df.count() for f in self.graph.edges)

    def schema(self) -> dict:
        return self.graph.schema()

    def info(self) -> dict:
        return {"nodes": self.node_count, "edges": self.edge_count, "labels": self.graph.labels(), "edge_types": self.graph.edge_types(), "is_persistent": self.is_persistent, "path": self.path}

    def stats(self) -> dict:
        """Sizes: nodes, edges, different labels, different property keys."""
        keys = {p for f in (*self.graph.nodes, *self.graph.edges) for p in f.properties}
        return {"node_count": self.node_count, "edge_count": self.edge_count, "label_count": len(self.graph.labels()), "property_count": len(keys)}

    def detailed_stats(self) -> DataFrame:
        """Counts by label and edge type: ``kind, name, n``."""
        nodes = self.graph.scan_nodes().select(F.explode("labels").alias("name")).groupBy("name").count().select(F.lit("label").alias("kind"), "name", F.col("count").alias("n"))
        edges = self.graph.scan_edges().groupBy("type").count().select(F.lit("edge_type").alias("kind"), F.col("type").alias("name"), F.col("count").alias("n"))
        return nodes.unionAll(edges)

    def validate(self) -> DataFrame:
        """Edges whose source or target is no node: ``type, src, dst, missing``."""
        ids = self.graph.scan_nodes().select("id")
        edges = self.graph.scan_edges().select("type", "src", "dst")
        lost = [edges.join(ids, edges[c] == ids["id"], "left_anti").withColumn("missing", F.lit(c)) for c in ("src", "dst")]
        return lost[0].unionAll(lost[1])

    def algorithms(self):
        from .algo.library import Algorithms

        return Algorithms(self.graph)

    def as_networkx(self, directed: bool = True):
        from .algo.adapters import NetworkXAdapter

        return NetworkXAdapter(self.algorithms(), directed)

    def as_solvor(self):
        from .algo.adapters import SolvorAdapter

        return SolvorAdapter(self.algorithms())

    # -- snapshots -------------------------------------------------------------------------------------------

    @property
    def path(self) -> str | None:
        """Where the database was opened from or saved to last."""
        return self._path

    @property
    def is_persistent(self) -> bool:
        return self._path is not None

    def save(self, path: str) -> None:
        """A new snapshot at ``path``; those that are there already stay as they are."""
        self.graph.save(f"{path}/graph")
        self.triples.save(f"{path}/triples")

    def close(self) -> None:
        """Save to the path the database was opened from, if there is one, and end open transactions."""
        self._held.clear()
        if self._path is not None:
            self.save(self._path)

    def to_memory(self) -> Database:
        """A copy that reads none of this database's files; it lives in the session's shared folder."""
        nodes = tuple(replace(f, df=cut(f.df)) for f in self.graph.nodes)
        edges = tuple(replace(f, df=cut(f.df)) for f in self.graph.edges)
        triples = replace(self.triples, df=cut(self.triples.df))
        return Database(self.spark, replace(self.graph, nodes=nodes, edges=edges), triples, max_hops=self.max_hops, walks=self.walks)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Database:
        """The last snapshot at ``path``."""
        db = Database(spark, PropertyGraph.open(spark, f"{path}/graph"), TripleStore.open(spark, f"{path}/triples"))
        db._path = path
        return db

    @staticmethod
    def open_in_memory(spark: SparkSession, path: str) -> Database:
        return Database.open(spark, path).to_memory()


class Query:
    """A query text and its parameters."""

    def __init__(self, db: Database, text: str):
        self.db, self.text, self.params = db, text, {}

    def param(self, name: str, value) -> Query:
        self.params[name] = value
        return self

    def execute(self) -> DataFrame:
        return self.db.execute(self.text, self.params)
