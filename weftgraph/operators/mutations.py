"""Graph updates: each takes a graph and gives a new one; frames that an update does not touch are shared.

New ids are the current maximum plus a number that is unique over partitions, given to checkpointed rows, so
they stay the same if a task runs again.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import QueryError
from ..plans import ir
from ..plans.lineage import cut
from ..plans.lower import Frame, Lowering, col
from ..sources.graph import EdgeFrame, NodeFrame, PropertyGraph, frame


def next_id(graph: PropertyGraph, kind: str) -> int:
    tops = []
    for f in graph.nodes if kind == "node" else graph.edges:
        if "id" in f.df.columns:
            tops.append(f.df.agg(F.max("id")).first()[0])
    return max([-1, *[t for t in tops if t is not None and t < 1 << 61]]) + 1


def add_node(graph: PropertyGraph, labels: list[str], props: dict) -> tuple[PropertyGraph, int]:
    new = next_id(graph, "node")
    return _grown(graph, frozenset(labels), frame(graph.spark, [{"id": new, **props}], ["id"])), new


def add_edge(graph: PropertyGraph, src: int, dst: int, type: str, props: dict) -> tuple[PropertyGraph, int]:
    new = next_id(graph, "edge")
    return graph.add_edges(frame(graph.spark, [{"id": new, "src": src, "dst": dst, **props}], ["id", "src", "dst"]), type), new


def _grown(graph: PropertyGraph, labels: frozenset[str], rows: DataFrame) -> PropertyGraph:
    """Rows join a frame with the same labels and column types, if there is one."""
    for k, f in enumerate(graph.nodes):
        if f.labels == labels and not f.dynamic and all(dict(f.df.dtypes).get(c, t) == t for c, t in rows.dtypes):
            joined = replace(f, df=f.df.unionByName(rows, allowMissingColumns=True))
            return replace(graph, nodes=(*graph.nodes[:k], joined, *graph.nodes[k + 1 :]))
    return graph.add_nodes(rows, labels)


def delete_nodes(graph: PropertyGraph, ids: DataFrame, detach: bool) -> PropertyGraph:
    """Without ``detach`` edges of the nodes stay, as they do in the language's reference behaviour."""
    nodes = tuple(replace(f, df=f.df.join(ids, "id", "left_anti")) for f in graph.nodes)
    edges = graph.edges
    if detach:
        ends = [ids.withColumnRenamed("id", c) for c in ("src", "dst")]
        edges = tuple(replace(f, df=f.df.join(ends[0], "src", "left_anti").join(ends[1], "dst", "left_anti").select(*f.df.columns)) for f in graph.edges)
    return replace(graph, nodes=nodes, edges=edges)


def delete_edges(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    return replace(graph, edges=tuple(replace(f, df=f.with_id().join(ids, "id", "left_anti").select(*f.df.columns)) for f in graph.edges))


def set_property(graph: PropertyGraph, kind: str, rows: DataFrame, key: str) -> PropertyGraph:
    """``rows``: ``id, value``. A property keeps its column's type; a new one takes the value's."""
    marked = rows.select("id", F.col("value").alias("_value"), F.lit(True).alias("_hit"))
    new_type = dict(rows.dtypes)["value"]

    def changed(f):
        df = f.df if kind == "node" else f.with_id()
        if key not in df.columns:
            if df.join(rows, "id", "left_semi").isEmpty():
                return f
            df = df.withColumn(key, F.lit(None).cast("string" if new_type == "void" else new_type))
        old = dict(df.dtypes)[key]
        out = df.join(marked, "id", "left").withColumn(key, F.when(F.col("_hit"), F.col("_value").cast(old)).otherwise(col(key)))
        return replace(f, df=out.select(*[col(c) for c in df.columns]))

    if kind == "node":
        return replace(graph, nodes=tuple(map(changed, graph.nodes)))
    return replace(graph, edges=tuple(map(changed, graph.edges)))


def set_labels(graph: PropertyGraph, ids: DataFrame, labels: list[str], remove: bool) -> PropertyGraph:
    """Frames are split: nodes that change move to a frame with the new labels."""
    out: list[NodeFrame] = []
    for f in graph.nodes:
        want = f.labels - set(labels) if remove else f.labels | set(labels)
        if f.dynamic:
            names = F.array(*[F.lit(x) for x in labels])
            new = F.array_except("labels", names) if remove else F.array_union("labels", names)
            hit = f.df.join(ids, "id", "left_semi").withColumn("labels", new)
            out.append(replace(f, labels=f.labels | set(labels), df=hit.unionByName(f.df.join(ids, "id", "left_anti"))))
        elif want == f.labels:
            out.append(f)
        else:
            hit = cut(f.df.join(ids, "id", "left_semi"))
            if hit.isEmpty():
                out.append(f)
            else:
                out += [replace(f, df=f.df.join(ids, "id", "left_anti")), NodeFrame(want, hit)]
    return replace(graph, nodes=tuple(out))


class Writing(Lowering):
    """Lowering of plans with updates: ``graph`` changes on the way."""

    def lower_create(self, op: ir.Create) -> Frame:
        frame = self.lower(op.input)
        for p in op.paths:
            frame = self.create_path(frame, p)
        return frame

    def create_path(self, frame: Frame, p: ir.Path) -> Frame:
        for n in p.nodes:
            if n.var not in frame.kinds:
                frame = self.create_node(frame, n)
        for k, e in enumerate(p.edges):
            a, b = p.nodes[k], p.nodes[k + 1]
            if e.variable or len(e.types) != 1:
                raise QueryError("a new edge has one type and one hop")
            if e.direction == "in":
                a, b = b, a
            frame = self.create_edge(frame, e, a.var, b.var)
        return frame

    def create_node(self, frame: Frame, n: ir.NodePat) -> Frame:
        v, base = n.var, next_id(self.graph, "node")
        props = {f"{v}:{k}": self.expr(frame, e) for k, e in n.props}
        df = frame.df.withColumns({**props, f"{v}@labels": F.array(*[F.lit(x) for x in n.labels]).cast("array<string>")})
        df = cut(df.withColumn(f"{v}@id", F.lit(base) + F.monotonically_increasing_id()))
        rows = df.select(col(f"{v}@id").alias("id"), *[col(f"{v}:{k}").alias(k) for k, _ in n.props])
        self.graph = _grown(self.graph, frozenset(n.labels), rows)
        return frame.bind(df, **{v: "node"})

    def create_edge(self, frame: Frame, e: ir.EdgePat, a: str, b: str) -> Frame:
        v, base = e.var, next_id(self.graph, "edge")
        props = {f"{v}:{k}": self.expr(frame, x) for k, x in e.props}
        df = frame.df.withColumns({**props, f"{v}@src": col(f"{a}@id"), f"{v}@dst": col(f"{b}@id"), f"{v}@type": F.lit(e.types[0])})
        df = cut(df.withColumn(f"{v}@id", F.lit(base) + F.monotonically_increasing_id()))
        rows = df.select(*[col(f"{v}@{x}").alias(x) for x in ("id", "src", "dst")], *[col(f"{v}:{k}").alias(k) for k, _ in e.props])
        self.graph = replace(self.graph, edges=(*self.graph.edges, EdgeFrame(e.types[0], rows)))
        return frame.bind(df, **({} if e.anonymous else {v: "edge"}))

    def lower_merge(self, op: ir.Merge) -> Frame:
        frame = self.lower(op.input)
        for n in (*op.path.nodes, *op.path.edges):
            self.used.setdefault(n.var, set()).add("*")
        frame = frame.bind(cut(frame.df.withColumn("_row", F.monotonically_increasing_id())), _row="value")
        found = self.match(frame, (op.path,), None)
        found = found.with_df(cut(found.df))
        keys = self.merge_keys(frame, op.path)
        missing = cut(frame.df.join(found.df.select("_row"), "_row", "left_anti").withColumns(keys))
        if not found.df.isEmpty() and op.on_match:
            found = self.set_items(found, op.on_match)
        if missing.isEmpty():
            return found
        # of rows that ask for the same pattern the first creates it and the others match what it made
        first = missing.groupBy(*keys).agg(F.min("_row").alias("_first")) if keys else missing.agg(F.min("_row").alias("_first"))
        made = self.create_path(frame.with_df(missing.join(first.select(F.col("_first").alias("_row")), "_row", "left_semi")), op.path)
        new = [v for v in made.kinds if v not in frame.kinds]
        what = made.df.select(*[F.col(k).alias(f"{k}_") for k in keys], *[col(c) for v in new for c in made.columns_of(v)])
        same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
        others = missing.join(made.df.select("_row"), "_row", "left_anti").join(what, reduce(lambda a, b: a & b, same) if same else F.lit(True))
        again = made.with_df(cut(others.drop(*[f"{k}_" for k in keys])))
        if op.on_create:
            made = self.set_items(made, op.on_create)
        if op.on_match and not again.df.isEmpty():
            again = self.set_items(again, op.on_match)
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [found.df, made.df, again.df])
        return Frame(out.drop(*keys), {**found.kinds, **made.kinds})

    def merge_keys(self, frame: Frame, path: ir.Path) -> dict[str, Column]:
        """What tells the patterns of two rows apart: the ids that are bound already and the inline properties."""
        keys = [col(f"{n.var}@id") for n in path.nodes if n.var in frame.kinds]
        for x in (*path.nodes, *path.edges):
            keys += [self.expr(frame, e) for _, e in x.props if x.var not in frame.kinds]
        return {f"_merge{k}": c for k, c in enumerate(keys)}

    def lower_setitems(self, op: ir.SetItems) -> Frame:
        frame = self.lower(op.input)
        return self.set_items(frame.with_df(cut(frame.df)), op.items)

    def set_items(self, frame: Frame, items) -> Frame:
        for var, key, e, mode in items:
            kind = frame.kinds.get(var)
            if kind not in ("node", "edge"):
                raise QueryError(f"{var} is no node or edge")
            pairs = [(key, e)]
            if key is None:
                values = dict(e.items) if isinstance(e, ir.MapOf) else {k: ir.Lit(v) for k, v in self.params[e.name].items()}
                have = {p for f in (self.graph.nodes if kind == "node" else self.graph.edges) for p in f.properties} if mode == "replace" else set()
                pairs = [*values.items(), *((k, ir.Lit(None)) for k in sorted(have - set(values)))]
            for k, x in pairs:
                value = self.expr(frame, x)
                rows = frame.df.select(col(f"{var}@id").alias("id"), value.alias("value")).dropDuplicates(["id"])
                self.graph = set_property(self.graph, kind, rows, k)
                frame = frame.with_df(frame.df.withColumn(f"{var}:{k}", value.cast(self.stored_type(kind, k) or "string")))
        return frame

    def stored_type(self, kind: str, key: str) -> str | None:
        """The type of a property's column where all frames agree on it, so that a query returns what it stored."""
        found = {dict(f.df.dtypes)[key] for f in (self.graph.nodes if kind == "node" else self.graph.edges) if key in f.df.columns}
        return found.pop() if len(found) == 1 else None

    def lower_setlabels(self, op: ir.SetLabels) -> Frame:
        frame = self.lower(op.input)
        frame = frame.with_df(cut(frame.df))
        ids = frame.df.select(col(f"{op.var}@id").alias("id")).distinct()
        self.graph = set_labels(self.graph, ids, list(op.labels), op.remove)
        return frame

    def lower_delete(self, op: ir.Delete) -> Frame:
        frame = self.lower(op.input)
        frame = frame.with_df(cut(frame.df))
        for v in sorted(op.vars, key=lambda v: frame.kinds.get(v) == "node"):
            ids = frame.df.select(col(f"{v}@id").alias("id")).distinct()
            if frame.kinds.get(v) == "edge":
                self.graph = delete_edges(self.graph, ids)
            elif frame.kinds.get(v) == "node":
                self.graph = delete_nodes(self.graph, ids, op.detach)
            else:
                raise QueryError(f"cannot delete {v}")
        return frame


def run(lowering: Lowering, plan: ir.Operator) -> tuple[PropertyGraph, DataFrame]:
    """The graph after the plan, and the plan's rows."""
    w = Writing(lowering.graph, lowering.params, lowering.max_hops, lowering.walks)
    out = w.run(plan)
    return w.graph, out.drop("_one", "_row")
