"""Lowering of the algebra to DataFrames.

A bound node ``v`` has the columns ``v@id``, ``v@labels`` and ``v:<property>``; an edge also ``v@src``,
``v@dst``, ``v@type``; a value has the column ``v``. Node tables are joined only where a query uses a
property or needs a label that the edge type does not imply, so a hop is one join with a narrow edge table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from ..functions import scalar
from ..functions.aggregates import aggregate, percentile_disc
from ..functions.scalar import QueryError
from ..operators import paths
from ..sources.graph import PropertyGraph
from . import ir


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    kinds: dict[str, str]  # variable -> node, edge, edges, path or value

    def with_df(self, df: DataFrame) -> Frame:
        return replace(self, df=df)

    def bind(self, df: DataFrame, **kinds: str) -> Frame:
        return Frame(df, {**self.kinds, **kinds})

    def columns_of(self, var: str) -> list[str]:
        return [c for c in self.df.columns if c == var or c.startswith((f"{var}@", f"{var}:"))]


class Lowering:
    """``max_hops`` bounds patterns without an upper limit; ``walks`` lets them repeat edges."""

    def __init__(self, graph: PropertyGraph, params: dict | None = None, max_hops: int = 10, walks: bool = False):
        self.graph, self.params, self.max_hops, self.walks = graph, params or {}, max_hops, walks
        self.used: dict[str, set[str]] = {}

    # -- entry ------------------------------------------------------------------------------------------

    def run(self, op: ir.Operator) -> DataFrame:
        self.learn_use(op)
        frame = self.lower(op)
        if any("@" in c or ":" in c for c in frame.df.columns) or not frame.df.columns:
            return self.outputs(frame)
        return frame.df

    def outputs(self, frame: Frame) -> DataFrame:
        """All variables as plain columns: a node or edge as its id."""
        out = [self.var(frame, v).alias(v) for v in frame.kinds if not v.startswith("_")]
        return frame.df.select(*out)

    def learn_use(self, op: ir.Operator) -> None:
        """Properties that are read of each variable; labels, types and ids count too."""
        renamed: dict[str, set[str]] = {}
        for x in ir.walk(op):
            if isinstance(x, ir.Prop) and isinstance(x.of, ir.Var):
                self.used.setdefault(x.of.name, set()).add(x.key)
            elif isinstance(x, ir.HasLabel) and isinstance(x.of, ir.Var):
                self.used.setdefault(x.of.name, set()).add("@labels")
            elif isinstance(x, ir.Call) and x.name.lower() in ("labels", "type", "id", "properties", "keys", "label", "value_map") and x.args and isinstance(x.args[0], ir.Var):
                need = {"labels": "@labels", "label": "@labels", "id": "@id", "type": "@type"}.get(x.name.lower(), "*")
                self.used.setdefault(x.args[0].name, set()).add(need)
            elif isinstance(x, (ir.NodePat, ir.EdgePat)) and x.props:
                self.used.setdefault(x.var, set()).update(k for k, _ in x.props)
            elif isinstance(x, ir.Item) and isinstance(x.expr, ir.Var):
                renamed.setdefault(x.expr.name, set()).add(x.alias)
            elif isinstance(x, ir.Call) and x.name.lower() == "count" and not x.distinct and x.args and isinstance(x.args[0], ir.Var):
                pass  # only asks whether it is bound
            elif isinstance(x, ir.Call) and x.args and isinstance(x.args[0], ir.Var):
                self.used.setdefault(x.args[0].name, set()).add("@id")
            elif isinstance(x, ir.WRITES):
                for v in [*getattr(x, "vars", ()), getattr(x, "var", None), *(i[0] for i in (*getattr(x, "items", ()), *getattr(x, "on_create", ()), *getattr(x, "on_match", ())))]:
                    if v:
                        self.used.setdefault(v, set()).add("@id")
            if isinstance(x, ir.Project):
                for it in x.items:
                    if isinstance(it.expr, ir.Var):
                        self.used.setdefault(it.expr.name, set()).add("@id")
        for _ in range(len(renamed)):
            for old, names in renamed.items():
                for new in names:
                    self.used.setdefault(old, set()).update(self.used.get(new, ()))

    def lower(self, op: ir.Operator) -> Frame:
        return getattr(self, f"lower_{type(op).__name__.lower()}")(op)

    # -- expressions --------------------------------------------------------------------------------------

    def kind(self, frame: Frame, c: Column) -> DataType:
        return frame.df.select(c.alias("x")).schema["x"].dataType

    def var(self, frame: Frame, name: str) -> Column:
        kind = frame.kinds.get(name)
        if kind is None:
            raise QueryError(f"undefined variable {name}")
        return col({"node": f"{name}@id", "edge": f"{name}@id", "edges": f"{name}@ids", "path": f"{name}@length"}.get(kind, name))

    def expr(self, frame: Frame, e: ir.Expr, local: dict[str, Column] | None = None) -> Column:
        go = lambda x: self.expr(frame, x, local)
        match e:
            case ir.Lit(value):
                return self.literal(value)
            case ir.Param(name):
                if name not in self.params:
                    raise QueryError(f"parameter ${name} has no value")
                return self.literal(self.params[name])
            case ir.Var(name):
                return local[name] if local and name in local else self.var(frame, name)
            case ir.Prop(of, key):
                return self.property(frame, of, key, local)
            case ir.HasLabel(ir.Var(name), labels):
                have = col(f"{name}@labels") if frame.kinds.get(name) == "node" else F.array(col(f"{name}@type"))
                return reduce(lambda a, b: a & b, [F.array_contains(have, x) for x in labels])
            case ir.Op(name, args):
                return self.operation(frame, name, [go(a) for a in args], args)
            case ir.Call():
                return self.call(frame, e, local)
            case ir.Case(subject, whens, otherwise):
                test = (lambda w: go(subject) == go(w)) if subject is not None else go
                out = reduce(lambda acc, wt: (F if acc is None else acc).when(test(wt[0]), go(wt[1])), whens, None)
                return out.otherwise(go(otherwise)) if otherwise is not None else out
            case ir.ListOf(items):
                return F.array(*[go(x) for x in items])
            case ir.MapOf(items):
                return F.struct(*[go(x).alias(k) for k, x in items])
            case ir.Index(of, at):
                x = go(of)
                kind = self.kind(frame, x) if not local else ArrayType(StringType())
                if isinstance(kind, StructType):
                    return x[at.value]
                return scalar.index(x, go(at), kind)
            case ir.Slice(of, low, high):
                x = go(of)
                return scalar.part(x, None if low is None else go(low), None if high is None else go(high), self.kind(frame, x) if not local else ArrayType(StringType()))
            case ir.Comprehension(var, over, where, give):
                x = go(over)
                if where is not None:
                    x = F.filter(x, lambda v: self.expr(frame, where, {**(local or {}), var: v}))
                return x if give is None else F.transform(x, lambda v: self.expr(frame, give, {**(local or {}), var: v}))
            case ir.Quantified(kind, var, over, where):
                test = lambda v: self.expr(frame, where, {**(local or {}), var: v})
                x = go(over)
                if kind == "any":
                    return F.exists(x, test)
                if kind == "all":
                    return F.forall(x, test)
                n = F.size(F.filter(x, test))
                return n == (0 if kind == "none" else 1)
            case ir.SubQuery():
                name = self.marks.get(e)
                if name is None:
                    raise QueryError("a pattern is not allowed here")
                return col(name)
        raise QueryError(f"cannot evaluate {e!r}")

    def literal(self, value) -> Column:
        if isinstance(value, list):
            return F.array(*[self.literal(v) for v in value])
        if isinstance(value, dict):
            return F.struct(*[self.literal(v).alias(k) for k, v in value.items()])
        if isinstance(value, int) and not isinstance(value, bool):
            return F.lit(value).cast("bigint")
        return F.lit(value)

    def property(self, frame: Frame, of: ir.Expr, key: str, local) -> Column:
        if isinstance(of, ir.Var) and not (local and of.name in local):
            kind = frame.kinds.get(of.name)
            if kind is None:
                raise QueryError(f"undefined variable {of.name}")
            if kind in ("node", "edge"):
                name = f"{of.name}:{key}"
                return col(name) if name in frame.df.columns else F.lit(None)
        return self.expr(frame, of, local)[key]

    def operation(self, frame: Frame, name: str, a: list[Column], args) -> Column:
        match name:
            case "=":
                return a[0] == a[1]
            case "<>":
                return a[0] != a[1]
            case "<":
                return a[0] < a[1]
            case "<=":
                return a[0] <= a[1]
            case ">":
                return a[0] > a[1]
            case ">=":
                return a[0] >= a[1]
            case "and":
                return a[0] & a[1]
            case "or":
                return a[0] | a[1]
            case "xor":
                return a[0] != a[1]
            case "not":
                return ~a[0]
            case "neg":
                return -a[0]
            case "+":
                kinds = [self.kind(frame, x) for x in a]
                if any(isinstance(k, StringType) for k in kinds):
                    return F.concat(a[0].cast("string"), a[1].cast("string"))
                return F.concat(*a) if isinstance(kinds[0], ArrayType) else a[0] + a[1]
            case "-":
                return a[0] - a[1]
            case "*":
                return a[0] * a[1]
            case "/":
                return scalar.divide(a[0], a[1], self.kind(frame, a[0]), self.kind(frame, a[1]))
            case "%":
                return F.try_mod(a[0], a[1])
            case "^":
                return F.pow(a[0].cast("double"), a[1].cast("double"))
            case "||":
                return F.concat(*a)
            case "like":
                return a[0].like(args[1].value)
            case "starts":
                return F.startswith(a[0], a[1])
            case "ends":
                return F.endswith(a[0], a[1])
            case "contains":
                return F.contains(a[0], a[1])
            case "=~":
                return F.rlike(a[0], a[1])
            case "in":
                if isinstance(args[1], ir.ListOf):
                    return a[0].isin(*[self.expr(frame, x) for x in args[1].items]) if args[1].items else F.lit(False)
                return F.array_contains(a[1], a[0])
            case "null":
                return a[0].isNull()
            case "notnull":
                return a[0].isNotNull()
        raise QueryError(f"unknown operator {name}")

    def call(self, frame: Frame, e: ir.Call, local) -> Column:
        name, first = e.name.lower(), e.args[0] if e.args else None
        of = first.name if isinstance(first, ir.Var) and not (local and first.name in local) else None
        kind = frame.kinds.get(of) if of else None
        if name in ("id", "elementid") and kind in ("node", "edge"):
            return col(f"{of}@id")
        if name in ("labels", "label") and kind == "node":
            return col(f"{of}@labels") if name == "labels" else F.get(col(f"{of}@labels"), F.lit(0))
        if name in ("type", "label") and kind == "edge":
            return col(f"{of}@type")
        if name == "haslabel" and of:
            return F.array_contains(col(f"{of}@labels"), self.expr(frame, e.args[1], local))
        if name in ("length", "size") and kind in ("path", "edges"):
            return col(f"{of}@length") if kind == "path" else F.size(col(f"{of}@ids")).cast("bigint")
        if name in ("keys", "properties", "value_map") and kind in ("node", "edge"):
            props = [c for c in frame.df.columns if c.startswith(f"{of}:")]
            pairs = F.array(*[F.struct(F.lit(c.split(":", 1)[1]).alias("key"), col(c).cast("string").alias("value")) for c in props])
            there = F.filter(pairs, lambda p: p["value"].isNotNull())
            return F.transform(there, lambda p: p["key"]) if name == "keys" else F.map_from_entries(there)
        if name in ("startnode", "endnode") and kind == "edge":
            return col(f"{of}@{'src' if name == 'startnode' else 'dst'}")
        args = [self.expr(frame, a, local) for a in e.args]
        needs = name in ("size", "length", "tointeger", "toint", "head", "tail", "reverse")
        return scalar.call(name, args, self.kind(frame, args[0]) if needs and not local else ArrayType(StringType()) if needs else None)

    # -- subqueries in predicates ---------------------------------------------------------------------------

    marks: dict = {}

    def with_subqueries(self, frame: Frame, exprs) -> Frame:
        """Add a column for every EXISTS or COUNT in the expressions: one grouped join each, nothing per row."""
        found = [x for e in exprs for x in ir.walk(e) if isinstance(x, ir.SubQuery)]
        for x in dict.fromkeys(found):
            name = f"_sub{len(self.marks)}"
            shared = [v for v in frame.kinds if any(n.var == v for p in x.paths for n in p.nodes) or any(isinstance(y, ir.Var) and y.name == v for y in ir.walk(x.where))]
            keys = [k for v in shared for k in ([f"{v}@id"] if frame.kinds[v] in ("node", "edge") else [v])]
            own = frame.df.select(*[col(c) for v in shared for c in frame.columns_of(v)]).dropDuplicates(keys) if keys else frame.df.limit(1).select(F.lit(1).alias("_one"))
            inner = self.match(Frame(own, {v: frame.kinds[v] for v in shared}), x.paths, x.where)
            counted = inner.df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias(name))
            joined = frame.df.join(counted, keys, "left") if keys else frame.df.crossJoin(F.broadcast(counted))
            value = F.coalesce(col(name), F.lit(0).cast("bigint"))
            frame = frame.with_df(joined.withColumn(name, value > 0 if x.kind == "exists" else value))
            self.marks = {**self.marks, x: name}
        return frame

    def filtered(self, frame: Frame, where: ir.Expr | None) -> Frame:
        """Conjuncts that are a bare (NOT) EXISTS become semi and anti joins; the rest a filter."""
        if where is None:
            return frame
        rest = []
        for part in conjuncts(where):
            negated = isinstance(part, ir.Op) and part.name == "not"
            inner = part.args[0] if negated else part
            if isinstance(inner, ir.SubQuery) and inner.kind == "exists":
                frame = self.semi(frame, inner, negated)
            else:
                rest.append(part)
        frame = self.with_subqueries(frame, rest)
        for part in rest:
            frame = frame.with_df(frame.df.where(self.expr(frame, part)))
        return frame.with_df(frame.df.drop(*[c for c in frame.df.columns if c.startswith("_sub")]))

    def semi(self, frame: Frame, x: ir.SubQuery, negated: bool) -> Frame:
        inside = {n.var for p in x.paths for n in p.nodes} | {y.name for y in ir.walk(x.where) if isinstance(y, ir.Var)}
        shared = [v for v in frame.kinds if v in inside]
        keys = [k for v in shared for k in ([f"{v}@id"] if frame.kinds[v] in ("node", "edge") else [v])]
        free = all(frame.kinds[v] == "node" for v in shared) and not ({y.of.name for y in ir.walk(x.where) if isinstance(y, ir.Prop) and isinstance(y.of, ir.Var)} & set(shared))
        if free and len(shared) == 1:
            inner = self.match(Frame(self.graph.spark.range(1).select(F.lit(1).alias("_one")), {}), x.paths, x.where, scan_bound=True)
        else:
            own = frame.df.select(*[col(c) for v in shared for c in frame.columns_of(v)]).dropDuplicates(keys)
            inner = self.match(Frame(own, {v: frame.kinds[v] for v in shared}), x.paths, x.where)
        return frame.with_df(frame.df.join(inner.df.select(*[col(k) for k in keys]), keys, "left_anti" if negated else "left_semi"))

    # -- patterns ---------------------------------------------------------------------------------------------

    def lower_start(self, op: ir.Start) -> Frame:
        return Frame(self.graph.spark.range(1).select(F.lit(1).alias("_one")), {})

    def lower_match(self, op: ir.Match) -> Frame:
        frame = self.lower(op.input)
        if not op.optional:
            return self.match(frame, op.paths, op.where)
        shared = [v for v in frame.kinds if any(n.var == v for p in op.paths for n in (*p.nodes, *p.edges)) or any(isinstance(y, ir.Var) and y.name == v for y in ir.walk(op.where))]
        keys = [k for v in shared for k in ([f"{v}@id"] if frame.kinds[v] in ("node", "edge") else [v])]
        own = frame.df.select(*[col(c) for v in shared for c in frame.columns_of(v)]).dropDuplicates(keys) if keys else self.lower_start(ir.Start()).df
        inner = self.match(Frame(own, {v: frame.kinds[v] for v in shared}), op.paths, op.where)
        new = {v: k for v, k in inner.kinds.items() if v not in frame.kinds}
        right = inner.df.select(*[col(k) for k in keys], *[col(c) for v in new for c in inner.columns_of(v)])
        if keys:
            df = frame.df.join(right, keys, "left")
        else:
            df = frame.df.join(right, F.lit(True), "left")
        return frame.bind(df, **new)

    def match(self, frame: Frame, patterns, where: ir.Expr | None, scan_bound: bool = False) -> Frame:
        """All patterns, connected ones first; single-variable conjuncts are applied as soon as they can be."""
        todo, waiting = list(patterns), conjuncts(where) if where is not None else []
        while todo:
            todo.sort(key=lambda p: not any(n.var in frame.kinds for n in p.nodes))
            frame = self.path(frame, todo.pop(0))
        return self.filtered(frame, ir_and(waiting))

    def node_scan(self, pat: ir.NodePat, within: frozenset[str] = frozenset()) -> Frame:
        df, used = self.graph.scan_nodes(pat.labels, within), self.used.get(pat.var, set())
        props = [c for c in df.columns if c not in ("id", "labels") and (c in used or "*" in used)]
        columns = [col("id").alias(f"{pat.var}@id"), col("labels").alias(f"{pat.var}@labels")]
        df = df.select(*columns, *[col(p).alias(f"{pat.var}:{p}") for p in props])
        return self.props(Frame(df, {pat.var: "node"}), pat, constant=True)

    def props(self, frame: Frame, pat, constant: bool | None = None) -> Frame:
        """Inline properties as conditions; with ``constant`` only those that use no variable, or only the others."""
        for key, e in pat.props:
            if constant is not None and constant == any(isinstance(x, ir.Var) for x in ir.walk(e)):
                continue
            frame = frame.with_df(frame.df.where(self.property(frame, ir.Var(pat.var), key, None) == self.expr(frame, e)))
        return frame

    def path(self, frame: Frame, p: ir.Path) -> Frame:
        if p.shortest:
            return self.shortest(frame, p)
        bound = [i for i, n in enumerate(p.nodes) if n.var in frame.kinds]
        start = bound[0] if bound else max(range(len(p.nodes)), key=lambda i: (len(p.nodes[i].props), bool(p.nodes[i].labels), -i))
        first = p.nodes[start]
        if first.var in frame.kinds:
            frame = self.check(frame, first)
        else:
            scan = self.node_scan(first)
            frame = scan if not frame.kinds else frame.bind(frame.df.crossJoin(scan.df), **scan.kinds)
            frame = self.props(frame, first, constant=False)
        lengths: list[Column] = []
        for i in range(start, len(p.edges)):
            frame = self.hop(frame, p.nodes[i], p.edges[i], p.nodes[i + 1])
        for i in range(start - 1, -1, -1):
            turned = replace(p.edges[i], direction={"out": "in", "in": "out"}.get(p.edges[i].direction, "both"))
            frame = self.hop(frame, p.nodes[i + 1], turned, p.nodes[i])
        if p.name:
            lengths = [col(f"{e.var}@length") if e.variable else F.lit(1).cast("bigint") for e in p.edges]
            total = reduce(lambda a, b: a + b, lengths, F.lit(0).cast("bigint"))
            frame = frame.bind(frame.df.withColumn(f"{p.name}@length", total), **{p.name: "path"})
        return frame

    def check(self, frame: Frame, pat: ir.NodePat) -> Frame:
        """A bound node met again: its labels and properties are conditions."""
        if pat.labels and f"{pat.var}@labels" in frame.df.columns:
            frame = frame.with_df(frame.df.where(self.expr(frame, ir.HasLabel(ir.Var(pat.var), pat.labels))))
        return self.props(frame, pat)

    def edge_table(self, e: ir.EdgePat, with_id: bool) -> tuple[DataFrame, frozenset[str]]:
        """Edges as ``_from, _to`` in the direction of travel and columns of the edge variable, and a label that
        every end of them has."""
        frames, used = self.graph.edge_frames(e.types), self.used.get(e.var, set())
        df = self.graph.scan_edges(e.types, with_id)
        props = [c for c in df.columns if c not in ("id", "src", "dst", "type") and (c in used or "*" in used or any(k == c for k, _ in e.props))]
        columns = [col("src").alias(f"{e.var}@src"), col("dst").alias(f"{e.var}@dst"), col("type").alias(f"{e.var}@type"), *([col("id").alias(f"{e.var}@id")] if with_id else []), *[col(x).alias(f"{e.var}:{x}") for x in props]]
        table = self.props(Frame(df.select(*columns), {e.var: "edge"}), e, constant=True).df
        out = table.select(col(f"{e.var}@src").alias("_from"), col(f"{e.var}@dst").alias("_to"), "*")
        back = table.select(col(f"{e.var}@dst").alias("_from"), col(f"{e.var}@src").alias("_to"), "*")
        ends = {"out": [f.to_labels for f in frames], "in": [f.from_labels for f in frames]}.get(e.direction, [f.to_labels for f in frames] + [f.from_labels for f in frames])
        common = frozenset.intersection(*ends) if ends else frozenset()
        return {"out": out, "in": back}.get(e.direction) if e.direction != "both" else out.unionAll(back), common

    def hop(self, frame: Frame, a: ir.NodePat, e: ir.EdgePat, b: ir.NodePat) -> Frame:
        used = self.used.get(e.var, set())
        if e.variable:
            frame, ends = self.hops(frame, a, e, b)
        else:
            table, ends = self.edge_table(e, with_id=not e.anonymous and bool({"@id", "*"} & used))
            df = frame.df.join(table, col(f"{a.var}@id") == F.col("_from")).drop("_from")
            frame = self.props(frame.bind(df, **{e.var: "edge"}), e, constant=False)
            if e.anonymous:
                frame = Frame(frame.df.drop(*frame.columns_of(e.var)), {v: k for v, k in frame.kinds.items() if v != e.var})
        if b.var in frame.kinds:
            return self.check(frame.with_df(frame.df.where(F.col("_to") == col(f"{b.var}@id")).drop("_to")), b)
        need = self.used.get(b.var, set()) - {"@id"}
        if not need and set(b.labels) <= ends and not b.props:
            return frame.bind(frame.df.withColumnRenamed("_to", f"{b.var}@id"), **{b.var: "node"})
        scan = self.node_scan(b, ends)
        return self.props(frame.bind(frame.df.join(scan.df, F.col("_to") == col(f"{b.var}@id")).drop("_to"), **scan.kinds), b, constant=False)

    def hops(self, frame: Frame, a: ir.NodePat, e: ir.EdgePat, b: ir.NodePat) -> tuple[Frame, frozenset[str]]:
        table, ends = self.edge_table(e, with_id=True)
        low = 1 if e.low is None else e.low
        high = e.high if e.high is not None else max(low, 1) - 1 + self.max_hops
        steps = table.select("_from", "_to", col(f"{e.var}@id").alias("_edge"))
        df = paths.variable_length(frame.df, f"{a.var}@id", steps, low, high, trail=not self.walks)
        df = df.withColumnRenamed("_length", f"{e.var}@length").withColumnRenamed("_edges", f"{e.var}@ids")
        return frame.bind(df, **{e.var: "edges"}), ends if low > 0 else frozenset()

    def shortest(self, frame: Frame, p: ir.Path) -> Frame:
        """Both ends are bound (or scanned); lengths come from one breadth-first search over all pairs."""
        if len(p.edges) != 1:
            raise QueryError("a shortest path has one variable-length edge")
        a, e, b = p.nodes[0], p.edges[0], p.nodes[1]
        for n in (a, b):
            if n.var in frame.kinds:
                frame = self.check(frame, n)
            else:
                scan = self.node_scan(n)
                frame = scan if not frame.kinds else frame.bind(frame.df.crossJoin(scan.df), **scan.kinds)
                frame = self.props(frame, n, constant=False)
        table, _ = self.edge_table(e, with_id=False)
        pairs = frame.df.select(col(f"{a.var}@id").alias("_a"), col(f"{b.var}@id").alias("_b")).distinct()
        found = paths.shortest_paths(pairs, table.select("_from", "_to"), e.high if e.high is not None else None)
        df = frame.df.join(found, (col(f"{a.var}@id") == F.col("_a")) & (col(f"{b.var}@id") == F.col("_b")), "left").drop("_a", "_b")
        if p.shortest == "all":
            df = df.withColumn("_copy", F.explode_outer(F.when(F.col("_paths") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("_paths"))))).drop("_copy")
        name = p.name or f"_{e.var}"
        return frame.bind(df.drop("_paths").withColumnRenamed("_length", f"{name}@length"), **{name: "path"})

    # -- rows ------------------------------------------------------------------------------------------------------

    def lower_filter(self, op: ir.Filter) -> Frame:
        return self.filtered(self.lower(op.input), op.where)

    def lower_unwind(self, op: ir.Unwind) -> Frame:
        frame = self.lower(op.input)
        return frame.bind(frame.df.withColumn(op.var, F.explode(self.expr(frame, op.expr))), **{op.var: "value"})

    def lower_union(self, op: ir.Union) -> Frame:
        parts = [Lowering(self.graph, self.params, self.max_hops, self.walks).run(p) for p in op.parts]
        df = reduce(lambda x, y: x.unionAll(y.toDF(*x.columns)), parts)
        return Frame(df if op.all else df.distinct(), {c: "value" for c in df.columns})

    def lower_project(self, op: ir.Project) -> Frame:
        frame = self.lower(op.input)
        items = [*(ir.Item(ir.Var(v), v) for v in frame.kinds if op.star and not v.startswith("_")), *op.items]
        order = [self.resolved(k.expr, items) for k in op.order]
        frame = self.with_subqueries(frame, [*(i.expr for i in items), *order])
        if any(ir.has_aggregate(i.expr) for i in items):
            frame, items, order, having = self.grouped(frame, items, order, op.having)
        else:
            having = op.having
        out, kinds = [], {}
        for it in items:
            columns, kind = self.carried(frame, it, op.final)
            out += columns
            kinds[it.alias] = kind
        scope = frame
        if having is not None:
            # HAVING and WITH ... WHERE see aliases first, then what was bound before
            names = {it.alias: it.expr for it in items}
            test = substituted(having, names)
            scope = self.filtered(scope, test)
        keys = []
        for k, (sort, e) in enumerate(zip(op.order, order)):
            keys.append((f"_sort{k}", self.expr(scope, e), sort.descending))
        df = scope.df.select(*out, *[c.alias(n) for n, c, _ in keys])
        if op.distinct:
            df = df.dropDuplicates([c for c in df.columns if not c.startswith("_sort")])
        if keys:
            df = df.orderBy(*[F.col(n).desc_nulls_first() if down else F.col(n).asc_nulls_last() for n, _, down in keys])
        if op.skip is not None:
            df = df.offset(int(self.number(op.skip)))
        if op.limit is not None:
            df = df.limit(int(self.number(op.limit)))
        return Frame(df.drop(*[n for n, _, _ in keys]), kinds)

    def number(self, e: ir.Expr) -> int:
        value = self.params[e.name] if isinstance(e, ir.Param) else e.value if isinstance(e, ir.Lit) else None
        if not isinstance(value, int):
            raise QueryError("SKIP and LIMIT take whole numbers")
        return value

    def resolved(self, e: ir.Expr, items) -> ir.Expr:
        """ORDER BY sees aliases, and otherwise what the items were made of."""
        return substituted(e, {it.alias: it.expr for it in items})

    def carried(self, frame: Frame, it: ir.Item, final: bool) -> tuple[list[Column], str]:
        """Columns of an item: a node or edge keeps all of its columns, unless the result is final."""
        if isinstance(it.expr, ir.Var) and not final:
            kind = frame.kinds.get(it.expr.name)
            if kind is None:
                raise QueryError(f"undefined variable {it.expr.name}")
            old = it.expr.name
            return [col(c).alias(it.alias + c[len(old) :]) for c in frame.columns_of(old)], kind
        return [self.expr(frame, it.expr).alias(it.alias)], "value"

    def grouped(self, frame: Frame, items, order, having):
        """Implicit grouping: items without an aggregate are keys; a node or edge is grouped by its id."""
        keys, wanted, kinds = [], [], {}
        calls: dict[ir.Expr, str] = {}
        places: list[tuple[str, DataFrame]] = []

        def pulled(e):
            if isinstance(e, ir.Call) and e.name.lower() in ir.AGGREGATES:
                return ir.Var(calls.setdefault(e, f"_agg{len(calls)}"))
            return rebuilt(e, pulled)

        new_items, made = [], {}
        for k, it in enumerate(items):
            if ir.has_aggregate(it.expr):
                new_items.append(ir.Item(pulled(it.expr), it.alias))
            elif isinstance(it.expr, ir.Var) and frame.kinds.get(it.expr.name) in ("node", "edge"):
                v = it.expr.name
                keys.append(col(f"{v}@id"))
                wanted += [F.first(col(c)).alias(c) for c in frame.columns_of(v) if c != f"{v}@id"]
                kinds[v] = frame.kinds[v]
                new_items.append(it)
            else:
                name = f"_key{k}"
                keys.append(self.expr(frame, it.expr).alias(name))
                kinds[name] = "value"
                made[it.expr] = name
                new_items.append(ir.Item(ir.Var(name), it.alias))

        def placed(e):
            if isinstance(e, ir.Expr) and e in made:
                return ir.Var(made[e])
            return pulled(e) if isinstance(e, ir.Call) and e.name.lower() in ir.AGGREGATES else rebuilt(e, placed)

        order = [placed(e) for e in order]
        if having is not None:
            having = placed(substituted(having, {it.alias: it.expr for it in items}))
        for e, name in calls.items():
            arg = None if e.star or not e.args else self.counted(frame, e) if e.name.lower() == "count" else self.expr(frame, e.args[0])
            kind = self.kind(frame, arg) if arg is not None and e.name.lower() == "sum" else None
            extra = [a.value if isinstance(a, ir.Lit) else self.params[a.name] for a in e.args[1:]]
            kinds[name] = "value"
            if e.name.lower().replace("_", "") == "percentiledisc" and arg is not None:
                places.append((name, percentile_disc(frame.df, keys, arg, float(extra[0]) if extra else 0.5)))
            else:
                wanted.append(aggregate(e.name, arg, kind, e.distinct, extra).alias(name))
        df = frame.df.groupBy(*keys).agg(*(wanted or [F.count(F.lit(1)).alias("_rows")]))
        own_keys = df.columns[: len(keys)]
        for name, found in places:
            same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(own_keys)], F.lit(True))
            df = df.join(found, same, "left").withColumnRenamed("_value", name).drop(*[f"_k{i}" for i in range(len(keys))])
        return Frame(df, kinds), new_items, order, having


    def counted(self, frame: Frame, e: ir.Call) -> Column:
        """What a count counts; of an edge its source will do, so that edges need no id for it."""
        x = e.args[0]
        if isinstance(x, ir.Var) and frame.kinds.get(x.name) == "edge" and not e.distinct:
            return col(f"{x.name}@src")
        return self.expr(frame, x)


def conjuncts(e: ir.Expr) -> list[ir.Expr]:
    if isinstance(e, ir.Op) and e.name == "and":
        return [*conjuncts(e.args[0]), *conjuncts(e.args[1])]
    return [e]


def ir_and(parts: list[ir.Expr]) -> ir.Expr | None:
    return reduce(lambda a, b: ir.Op("and", (a, b)), parts) if parts else None


def rebuilt(x, change):
    """The same value with ``change`` applied to its parts."""
    if isinstance(x, ir.Expr):
        from dataclasses import fields

        return type(x)(**{f.name: rebuilt_part(getattr(x, f.name), change) for f in fields(x)})
    return x


def rebuilt_part(x, change):
    if isinstance(x, ir.Expr):
        return change(x)
    if isinstance(x, tuple):
        return tuple(rebuilt_part(y, change) for y in x)
    return x


def substituted(e, names: dict[str, ir.Expr]):
    """Replace variables that are aliases by what they stand for."""
    if isinstance(e, ir.Var) and e.name in names:
        return names[e.name]
    return rebuilt(e, lambda x: substituted(x, names))
