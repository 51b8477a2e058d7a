"""Gremlin: a chain of steps, each a change to a frame of traversers.

A traverser stands on ``_c``: a node, an edge or a value. Marks from ``as()`` are variables of their own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import QueryError
from ..operators import mutations
from ..plans import ir
from ..plans.lineage import cut
from ..plans.lower import Frame, Lowering, col
from .lexing import Cursor, tokens

_TOKENS = re.compile(r"""(?P<skip>\s+|//[^\n]*)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<float>-?\d+\.\d+[fFdD]?)|(?P<int>-?\d+[lL]?)|(?P<name>[^\W\d]\w*)|(?P<symbol>[.(),\[\]:])""", re.X)


@dataclass(frozen=True)
class Step:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Test:
    """A predicate such as gt(5)."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Word:
    name: str


PREDICATES = {"eq", "neq", "lt", "lte", "gt", "gte", "within", "without", "between", "inside", "outside", "containing", "startingWith", "endingWith", "notContaining", "notStartingWith", "notEndingWith", "regex", "not"}


def parse(text: str) -> list[Step]:
    c = tokens(text.strip().rstrip(";"), _TOKENS)
    if c.now.text != "g":
        c.fail("a traversal starts with g")
    c.step()
    steps = chain(c)
    if not c.end():
        c.fail("unexpected input")
    return steps


def chain(c: Cursor) -> list[Step]:
    out = []
    while c.sym("."):
        out.append(step(c))
    return out


def step(c: Cursor) -> Step:
    name = c.name()
    if not c.sym("("):
        return Step(name)
    args = []
    while not c.is_sym(")"):
        args.append(argument(c))
        if not c.sym(","):
            break
    c.need(")")
    return Step(name, tuple(args))


def argument(c: Cursor):
    t = c.now
    if t.kind == "string":
        return c.step().text
    if t.kind == "int":
        return int(c.step().text.rstrip("lL"))
    if t.kind == "float":
        return float(c.step().text.rstrip("fFdD"))
    if c.sym("["):
        out = []
        while not c.sym("]"):
            out.append(argument(c))
            c.sym(",")
        return out
    name = c.name()
    if name in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[name]
    if name == "__":
        return tuple(chain(c))
    if name in ("P", "TextP", "T", "Order", "Scope", "Direction"):
        c.need(".")
        name = c.name()
    if not c.is_sym("("):
        return Word(name)
    c.at -= 1
    first = step(c)
    if first.name in PREDICATES:
        return Test(first.name, first.args)
    return (first, *chain(c))  # an anonymous traversal without __


@dataclass
class Walk:
    """Traversers: the frame, what they stand on, and what the next by() steps refine."""

    frame: Frame
    kind: str  # node, edge, value
    pending: list = field(default_factory=list)
    history: tuple[str, ...] = ()


class Traversal:
    def __init__(self, db, params: dict | None):
        self.db, self.params, self.n = db, params or {}, 0
        self.low = Lowering(db.graph, params, db.max_hops, True)
        self.low.used = _Everything()

    # -- helpers -----------------------------------------------------------------------------------------

    def fresh(self) -> str:
        self.n += 1
        return f"_v{self.n}"

    def on(self, w: Walk, var: str, kind: str, df: DataFrame, kinds: dict[str, str]) -> Walk:
        """Stand on variable ``var``: its columns are copied to ``_c``."""
        f = Frame(df, kinds)
        copies = [col(c).alias("_c" + c[len(var) :]) for c in f.columns_of(var)]
        rest = [col(c) for c in df.columns if not (c == "_c" or c.startswith(("_c@", "_c:")))]
        return Walk(Frame(df.select(*rest, *copies), {**kinds, "_c": kind}), kind, history=(*w.history, var))

    def value(self, w: Walk, c: Column, group: bool = False) -> Walk:
        df = w.frame.df.withColumn("_new", c)
        df = df.select(*[col(x) for x in w.frame.df.columns if not (x == "_c" or x.startswith(("_c@", "_c:")))], F.col("_new").alias("_c"))
        return Walk(Frame(df, {**w.frame.kinds, "_c": "value"}), "value", history=w.history)

    def current(self, w: Walk) -> Column:
        return col("_c@id") if w.kind in ("node", "edge") else col("_c")

    def prop(self, w: Walk, key: str) -> Column:
        return col(f"_c:{key}") if f"_c:{key}" in w.frame.df.columns else F.lit(None).cast("string")

    def test(self, c: Column, p) -> Column:
        if not isinstance(p, Test):
            return c == F.lit(p)
        a = p.args
        match p.name:
            case "eq":
                return c == F.lit(a[0])
            case "neq":
                return c != F.lit(a[0])
            case "lt":
                return c < F.lit(a[0])
            case "lte":
                return c <= F.lit(a[0])
            case "gt":
                return c > F.lit(a[0])
            case "gte":
                return c >= F.lit(a[0])
            case "within":
                return c.isin(*(a[0] if a and isinstance(a[0], list) else a))
            case "without":
                return ~c.isin(*(a[0] if a and isinstance(a[0], list) else a))
            case "between":
                return (c >= F.lit(a[0])) & (c < F.lit(a[1]))
            case "inside":
                return (c > F.lit(a[0])) & (c < F.lit(a[1]))
            case "outside":
                return (c < F.lit(a[0])) | (c > F.lit(a[1]))
            case "containing":
                return c.contains(a[0])
            case "startingWith":
                return c.startswith(a[0])
            case "endingWith":
                return c.endswith(a[0])
            case "notContaining":
                return ~c.contains(a[0])
            case "notStartingWith":
                return ~c.startswith(a[0])
            case "notEndingWith":
                return ~c.endswith(a[0])
            case "regex":
                return c.rlike(a[0])
            case "not":
                return ~self.test(c, a[0])
        raise QueryError(f"unknown predicate {p.name}")

    def hop(self, w: Walk, types: tuple, direction: str, to_edge: bool) -> Walk:
        pat = ir.EdgePat(self.fresh(), tuple(types), direction)
        table, ends = self.low.edge_table(pat, with_id=True)
        df = w.frame.df.join(table, col("_c@id") == F.col("_from")).drop("_from")
        if to_edge:
            return self.on(w, pat.var, "edge", df.drop("_to"), {**w.frame.kinds, pat.var: "edge"})
        return self.arrive(w, df.drop(*[c for c in df.columns if c.startswith((f"{pat.var}@", f"{pat.var}:"))]), w.frame.kinds, "_to", ends)

    def arrive(self, w: Walk, df: DataFrame, kinds, at: str, within=frozenset()) -> Walk:
        scan = self.low.node_scan(ir.NodePat(self.fresh()), within)
        (var,) = scan.kinds
        return self.on(w, var, "node", df.join(scan.df, col(at) == col(f"{var}@id")).drop("_to"), {**kinds, **scan.kinds})

    def sub(self, w: Walk, steps: tuple) -> tuple[Walk, str]:
        """Run an anonymous traversal from each traverser; a row number says which one a result belongs to."""
        key = f"_r{self.fresh()}"
        start = Walk(w.frame.bind(cut(w.frame.df.withColumn(key, F.monotonically_increasing_id())), **{key: "value"}), w.kind, history=w.history)
        return start, key

    def kept(self, w: Walk, steps: tuple, negate: bool = False) -> Walk:
        start, key = self.sub(w, steps)
        end = self.run(Walk(start.frame, w.kind, history=w.history), steps)
        df = start.frame.df.join(end.frame.df.select(key).distinct(), key, "left_anti" if negate else "left_semi")
        return Walk(Frame(df.drop(key), w.frame.kinds), w.kind, history=w.history)

    # -- steps -------------------------------------------------------------------------------------------------

    def run(self, w: Walk | None, steps) -> Walk:
        for k, s in enumerate(steps):
            method = getattr(self, f"step_{s.name}", None)
            if method is None:
                raise QueryError(f"unknown step {s.name}")
            if w is not None and w.pending and s.name not in ("by", "from", "to", "times", "emit", "option", "until"):
                w = self.settle(w)
            w = method(w, *s.args)
        return self.settle(w) if w is not None and w.pending else w

    def settle(self, w: Walk) -> Walk:
        (name, *args), w.pending = w.pending, []
        return getattr(self, f"settle_{name}")(w, *args)

    def step_V(self, w, *ids):
        scan = self.low.node_scan(ir.NodePat(self.fresh()))
        (var,) = scan.kinds
        df = scan.df.where(col(f"{var}@id").isin(*ids)) if ids else scan.df
        if w is not None and w.frame.kinds:
            return self.on(w, var, "node", w.frame.df.crossJoin(df), {**w.frame.kinds, **scan.kinds})
        return self.on(Walk(scan, "node"), var, "node", df, scan.kinds)

    def step_E(self, w, *ids):
        pat = ir.EdgePat(self.fresh())
        table, _ = self.low.edge_table(pat, with_id=True)
        df = table.drop("_from", "_to")
        if ids:
            df = df.where(col(f"{pat.var}@id").isin(*ids))
        return self.on(Walk(Frame(df, {}), "edge"), pat.var, "edge", df, {pat.var: "edge"})

    def step_hasLabel(self, w, *names):
        if w.kind == "edge":
            return replace(w, frame=w.frame.with_df(w.frame.df.where(col("_c@type").isin(*names))))
        return replace(w, frame=w.frame.with_df(w.frame.df.where(F.arrays_overlap(col("_c@labels"), F.array(*[F.lit(n) for n in names])))))

    def step_has(self, w, *a):
        if len(a) == 3:
            return self.step_has(self.step_hasLabel(w, a[0]), *a[1:])
        key = a[0].name if isinstance(a[0], Word) else a[0]
        if isinstance(a[0], Word) and key == "label":
            return self.step_hasLabel(w, *(a[1].args if isinstance(a[1], Test) else a[1:]))
        c = self.current(w) if isinstance(a[0], Word) and key == "id" else self.prop(w, key)
        return replace(w, frame=w.frame.with_df(w.frame.df.where(c.isNotNull() if len(a) == 1 else self.test(c, a[1]))))

    def step_hasNot(self, w, key):
        return replace(w, frame=w.frame.with_df(w.frame.df.where(self.prop(w, key).isNull())))

    def step_hasId(self, w, *ids):
        return replace(w, frame=w.frame.with_df(w.frame.df.where(self.current(w).isin(*ids))))

    def step_is(self, w, p):
        return replace(w, frame=w.frame.with_df(w.frame.df.where(self.test(self.current(w), p))))

    def step_out(self, w, *t):
        return self.hop(w, t, "out", False)

    def step_in(self, w, *t):
        return self.hop(w, t, "in", False)

    def step_both(self, w, *t):
        return self.hop(w, t, "both", False)

    def step_outE(self, w, *t):
        return self.hop(w, t, "out", True)

    def step_inE(self, w, *t):
        return self.hop(w, t, "in", True)

    def step_bothE(self, w, *t):
        return self.hop(w, t, "both", True)

    def step_outV(self, w):
        return self.arrive(w, w.frame.df, w.frame.kinds, "_c@src")

    def step_inV(self, w):
        return self.arrive(w, w.frame.df, w.frame.kinds, "_c@dst")

    def step_bothV(self, w):
        df = w.frame.df.withColumn("_to", F.explode(F.array(col("_c@src"), col("_c@dst"))))
        return self.arrive(w, df, w.frame.kinds, "_to")

    def step_otherV(self, w):
        before = next((v for v in reversed(w.history[:-1]) if w.frame.kinds.get(v) == "node"), None)
        if before is None:
            raise QueryError("otherV() needs a vertex before the edge")
        df = w.frame.df.withColumn("_to", F.when(col("_c@src") == col(f"{before}@id"), col("_c@dst")).otherwise(col("_c@src")))
        return self.arrive(w, df, w.frame.kinds, "_to")

    def step_values(self, w, *keys):
        keys = keys or [c[3:] for c in w.frame.df.columns if c.startswith("_c:")]
        if len(keys) == 1:
            out = self.value(w, self.prop(w, keys[0]))
        else:
            out = self.value(w, F.explode(F.array(*[self.prop(w, k).cast("string") for k in keys])))
        return replace(out, frame=out.frame.with_df(out.frame.df.where(col("_c").isNotNull())))

    def pairs(self, w, keys, extra=()):
        keys = keys or [c[3:] for c in w.frame.df.columns if c.startswith("_c:")]
        every = F.array(*extra, *[F.struct(F.lit(k).alias("key"), self.prop(w, k).cast("string").alias("value")) for k in keys])
        return F.filter(every, lambda p: p["value"].isNotNull())

    def step_valueMap(self, w, *keys):
        return self.value(w, F.map_from_entries(self.pairs(w, [k for k in keys if isinstance(k, str)])))

    def step_elementMap(self, w, *keys):
        extra = [F.struct(F.lit("id").alias("key"), col("_c@id").cast("string").alias("value")), F.struct(F.lit("label").alias("key"), self.label(w).alias("value"))]
        return self.value(w, F.map_from_entries(self.pairs(w, list(keys), extra)))

    def step_properties(self, w, *keys):
        return self.value(w, F.explode(self.pairs(w, list(keys))))

    def label(self, w):
        return col("_c@type") if w.kind == "edge" else F.get(col("_c@labels"), F.lit(0))

    def step_id(self, w):
        return self.value(w, self.current(w))

    def step_label(self, w):
        return self.value(w, self.label(w))

    def step_constant(self, w, x):
        return self.value(w, F.lit(x))

    def step_identity(self, w):
        return w

    def collapsed(self, w, agg) -> Walk:
        keys = [k for k in w.frame.kinds if k.startswith("_r_v")]
        grouped = w.frame.df.groupBy(*[col(k) for k in keys]).agg(agg.alias("_c"))
        return Walk(Frame(grouped, {**{k: "value" for k in keys}, "_c": "value"}), "value", history=w.history)

    def step_count(self, w):
        return self.collapsed(w, F.count(F.lit(1)))

    def step_sum(self, w):
        return self.collapsed(w, F.sum(col("_c")))

    def step_mean(self, w):
        return self.collapsed(w, F.avg(col("_c")))

    def step_min(self, w):
        return self.collapsed(w, F.min(col("_c")))

    def step_max(self, w):
        return self.collapsed(w, F.max(col("_c")))

    def step_fold(self, w):
        return self.collapsed(w, F.collect_list(self.current(w)))

    def step_unfold(self, w):
        return self.value(w, F.explode(col("_c")))

    def step_dedup(self, w, *marks):
        names = [n for m in marks for n in ([f"{m}@id"] if w.frame.kinds[m] in ("node", "edge") else [m])]
        own = [k for k in w.frame.kinds if k.startswith("_r_v")]
        return replace(w, frame=w.frame.with_df(w.frame.df.dropDuplicates([*own, *(names or ["_c@id" if w.kind in ("node", "edge") else "_c"])])))

    def step_limit(self, w, n):
        return replace(w, frame=w.frame.with_df(w.frame.df.limit(n)))

    def step_skip(self, w, n):
        return replace(w, frame=w.frame.with_df(w.frame.df.offset(n)))

    def step_range(self, w, a, b):
        df = w.frame.df.offset(a)
        return replace(w, frame=w.frame.with_df(df if b < 0 else df.limit(b - a)))

    def step_tail(self, w, n=1):
        raise QueryError("tail() has no meaning for unordered rows; use order() and limit()")

    def step_order(self, w, *a):
        return replace(w, pending=["order"])

    def settle_order(self, w, *bys):
        keys = []
        for by in bys or [(None, "asc")]:
            what, way = by
            c = self.current(w) if what is None else self.by(w, what)
            keys.append(c.desc_nulls_first() if way in ("desc", "decr") else c.asc_nulls_last())
        return replace(w, frame=w.frame.with_df(w.frame.df.orderBy(*keys)), pending=[])

    def by(self, w, what) -> Column:
        if isinstance(what, str):
            return self.prop(w, what)
        if isinstance(what, Word):
            return {"id": self.current(w), "label": self.label(w) if w.kind != "value" else None}.get(what.name)
        if isinstance(what, tuple) and len(what) == 1:
            s = what[0]
            if s.name == "values":
                return self.prop(w, s.args[0])
            if s.name == "id":
                return self.current(w)
            if s.name == "label":
                return self.label(w)
            if s.name == "constant":
                return F.lit(s.args[0])
            if s.name == "count":
                return F.lit(1)
        raise QueryError("by() takes a key, T.id, T.label or one of values, id, label, constant, count")

    def step_by(self, w, *a):
        if not w.pending:
            raise QueryError("by() refines no step")
        name, *bys = w.pending
        if name == "order":
            way = next((x.name for x in a if isinstance(x, Word) and x.name in ("asc", "desc", "incr", "decr")), "asc")
            what = next((x for x in a if not (isinstance(x, Word) and x.name in ("asc", "desc", "incr", "decr"))), None)
            return replace(w, pending=[name, *bys, (what, way)])
        return replace(w, pending=[name, *bys, a[0] if a else None])

    def step_as(self, w, *names):
        df, kinds = w.frame.df, dict(w.frame.kinds)
        for n in names:
            for c in w.frame.columns_of("_c"):
                df = df.withColumn(n + c[2:], col(c))
            kinds[n] = w.kind
        return Walk(Frame(df, kinds), w.kind, history=(*w.history[:-1], names[0]) if w.history else ())

    def step_select(self, w, *names):
        if len(names) == 1:
            n = names[0]
            out = self.on(w, n, w.frame.kinds[n], w.frame.df, w.frame.kinds)
            return replace(out, pending=["only"])
        return replace(w, pending=["select", names])

    def settle_only(self, w, *bys):
        return self.value(w, self.by(w, bys[0])) if bys else w

    def settle_select(self, w, names, *bys):
        parts = []
        for k, n in enumerate(names):
            kind = w.frame.kinds[n]
            by = bys[k % len(bys)] if bys else None
            c = col(f"{n}@id") if kind in ("node", "edge") else col(n)
            if isinstance(by, str):
                c = col(f"{n}:{by}") if f"{n}:{by}" in w.frame.df.columns else F.lit(None).cast("string")
            parts.append(c.alias(n))
        return self.value(w, F.struct(*parts))

    def step_project(self, w, *names):
        return replace(w, pending=["project", names])

    def settle_project(self, w, names, *bys):
        df, parts = w.frame, []
        for k, n in enumerate(names):
            by = bys[k] if k < len(bys) else None
            if isinstance(by, tuple) and not (len(by) == 1 and by[0].name in ("values", "id", "label", "constant")):
                start, key = self.sub(Walk(df, w.kind, history=w.history), by)
                end = self.run(start, by)
                many = [s.name for s in by if s.name in ("count", "sum", "min", "max", "mean", "fold")]
                each = end.frame.df.select(key, self.current(end).alias(f"_p{n}")).groupBy(key).agg(F.first(f"_p{n}").alias(f"_p{n}"))
                joined = start.frame.df.join(each, key, "left").drop(key)
                if many and many[-1] == "count":
                    joined = joined.withColumn(f"_p{n}", F.coalesce(col(f"_p{n}"), F.lit(0).cast("bigint")))
                df = Frame(joined, df.kinds)
                parts.append(col(f"_p{n}").alias(n))
            else:
                parts.append((self.current(w) if by is None else self.by(w, by)).alias(n))
        return self.value(Walk(df, w.kind, history=w.history), F.struct(*parts))

    def step_group(self, w, *a):
        return replace(w, pending=["group"])

    def settle_group(self, w, *bys):
        key = self.by(w, bys[0]) if bys else self.current(w)
        if len(bys) > 1 and isinstance(bys[1], tuple) and bys[1][-1].name in ("count", "sum", "mean", "min", "max"):
            last, inner = bys[1][-1].name, self.by(w, bys[1][:-1]) if len(bys[1]) > 1 else self.current(w)
            agg = {"count": F.count(F.lit(1)), "sum": F.sum(inner), "mean": F.avg(inner), "min": F.min(inner), "max": F.max(inner)}[last]
        else:
            agg = F.collect_list(self.by(w, bys[1]) if len(bys) > 1 else self.current(w))
        df = w.frame.df.groupBy(key.alias("key")).agg(agg.alias("value"))
        return Walk(Frame(df, {"key": "value", "value": "value"}), "pairs")

    def step_groupCount(self, w, *a):
        return replace(w, pending=["groupCount"])

    def settle_groupCount(self, w, *bys):
        key = self.by(w, bys[0]) if bys else self.current(w)
        return Walk(Frame(w.frame.df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("value")), {"key": "value", "value": "value"}), "pairs")

    def step_path(self, w):
        seen = [v for v in w.history if v in w.frame.kinds]
        ids = [col(f"{v}@id") for v in seen if w.frame.kinds[v] in ("node", "edge")]
        return self.value(w, F.array(*ids))

    def step_simplePath(self, w):
        seen = [f"{v}@id" for v in w.history if w.frame.kinds.get(v) == "node"]
        ids = F.array(*[col(c) for c in seen])
        return replace(w, frame=w.frame.with_df(w.frame.df.where(F.size(F.array_distinct(ids)) == len(seen))))

    def step_filter(self, w, what):
        return self.kept(w, what) if isinstance(what, tuple) else self.step_is(w, what)

    def step_where(self, w, *a):
        if len(a) == 2:
            return replace(w, frame=w.frame.with_df(w.frame.df.where(self.marked(w, a[0], a[1]))))
        if isinstance(a[0], Test):
            return replace(w, frame=w.frame.with_df(w.frame.df.where(self.marked(w, None, a[0]))))
        return self.kept(w, a[0])

    def marked(self, w, left, p) -> Column:
        ref = lambda n: col(f"{n}@id") if w.frame.kinds[n] in ("node", "edge") else col(n)
        a, b = self.current(w) if left is None else ref(left), ref(p.args[0])
        return {"eq": a == b, "neq": a != b, "lt": a < b, "lte": a <= b, "gt": a > b, "gte": a >= b}[p.name]

    def step_not(self, w, steps):
        return self.kept(w, steps, True)

    def step_and(self, w, *parts):
        for p in parts:
            w = self.kept(w, p)
        return w

    def step_or(self, w, *parts):
        start, key = self.sub(w, ())
        hits = [self.run(Walk(start.frame, w.kind, history=w.history), p).frame.df.select(key) for p in parts]
        every = hits[0]
        for h in hits[1:]:
            every = every.unionAll(h)
        return Walk(Frame(start.frame.df.join(every.distinct(), key, "left_semi").drop(key), w.frame.kinds), w.kind, history=w.history)

    def merged(self, ends: list[Walk]) -> Walk:
        kinds = {e.kind for e in ends}
        if len(kinds) > 1 or kinds == {"value"}:
            frames = [e.frame.df.select(*[col(k) for k in e.frame.kinds if k.startswith("_r_v")], self.current(e).cast("string" if len(kinds) > 1 else e.frame.df.schema["_c"].dataType).alias("_c")) for e in ends]
            out = frames[0]
            for f in frames[1:]:
                out = out.unionByName(f, allowMissingColumns=True)
            return Walk(Frame(out, {"_c": "value", **{c: "value" for c in out.columns}}), "value")
        shared = [k for k in ends[0].frame.kinds if all(k in e.frame.kinds for e in ends)]
        out = None
        for e in ends:
            part = e.frame.df.select(*[col(c) for k in shared for c in e.frame.columns_of(k)])
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return Walk(Frame(out, {k: ends[0].frame.kinds[k] for k in shared}), ends[0].kind)

    def step_union(self, w, *parts):
        return self.merged([self.run(Walk(w.frame, w.kind, history=w.history), p) for p in parts])

    def step_coalesce(self, w, *parts):
        start, key = self.sub(w, ())
        rest, ends = start.frame, []
        for p in parts:
            end = self.run(Walk(rest, w.kind, history=w.history), p)
            ends.append(end)
            rest = rest.with_df(rest.df.join(end.frame.df.select(key).distinct(), key, "left_anti"))
        return self.merged(ends)

    def step_optional(self, w, steps):
        return self.step_coalesce(w, steps, (Step("identity"),))

    def step_choose(self, w, test, then, other=(Step("identity"),)):
        start, key = self.sub(w, ())
        hit = self.run(Walk(start.frame, w.kind, history=w.history), test).frame.df.select(key).distinct()
        yes = start.frame.with_df(start.frame.df.join(hit, key, "left_semi"))
        no = start.frame.with_df(start.frame.df.join(hit, key, "left_anti"))
        return self.merged([self.run(Walk(yes, w.kind, history=w.history), then), self.run(Walk(no, w.kind, history=w.history), other)])

    def step_repeat(self, w, steps):
        return replace(w, pending=["repeat", steps, 1, False])

    def step_times(self, w, n):
        return replace(w, pending=[*w.pending[:2], n, w.pending[3]])

    def step_emit(self, w):
        return replace(w, pending=[*w.pending[:3], True])

    def settle_repeat(self, w, steps, times, emit):
        ends = []
        for _ in range(times):
            w = self.run(Walk(w.frame, w.kind, history=w.history), steps)
            ends.append(w)
        return self.merged(ends) if emit else w

    def step_sideEffect(self, w, steps):
        self.run(Walk(w.frame, w.kind, history=w.history), steps)
        return w

    def step_aggregate(self, w, name):
        return self.step_as(w, name)

    step_store = step_aggregate

    # -- updates -------------------------------------------------------------------------------------------------

    def step_addV(self, w, label="vertex"):
        return Walk(w.frame if w else self.low.lower_start(ir.Start()), "none", ["addV", label, {}])

    def step_addE(self, w, label):
        return Walk(w.frame if w else self.low.lower_start(ir.Start()), w.kind if w else "none", ["addE", label, {}, None, None], w.history if w else ())

    def step_property(self, w, key, value):
        if isinstance(key, Word):  # cardinality comes first
            raise QueryError("property cardinalities are not supported")
        rows = w.frame.df.select(col("_c@id").alias("id"), F.lit(value).alias("value")).distinct()
        self.db.graph = mutations.set_property(self.db.graph, w.kind, cut(rows), key)
        self.low.graph = self.db.graph
        return replace(w, frame=w.frame.with_df(cut(w.frame.df.withColumn(f"_c:{key}", F.lit(value)))))

    def step_from(self, w, mark):
        return replace(w, pending=[*w.pending[:3], mark, w.pending[4]])

    def step_to(self, w, mark):
        return replace(w, pending=[*w.pending[:4], mark])

    def settle_addV(self, w, label, props):
        self.db.graph, new = mutations.add_node(self.db.graph, [label], props)
        self.low.graph = self.db.graph
        return self.step_V(None, new)

    def settle_addE(self, w, label, props, a, b):
        wr = mutations.Writing(self.db.graph, {}, 10)
        ends = {}
        for name, mark in (("_src", a), ("_dst", b)):
            if mark is None:
                ends[name] = col("_c@id")
            elif isinstance(mark, str):
                ends[name] = col(f"{mark}@id")
            else:
                end = self.run(None, mark)
                ends[name] = F.lit(end.frame.df.select("`_c@id`").first()[0])
        rows = w.frame.df.select(ends["_src"].alias("s@id"), ends["_dst"].alias("d@id"))
        pat = ir.EdgePat("e", (label,), "out", tuple((k, ir.Lit(v)) for k, v in props.items()))
        made = wr.create_edge(Frame(rows, {"s": "node", "d": "node"}), pat, "s", "d")
        self.db.graph = self.low.graph = wr.graph
        return self.on(w, "e", "edge", made.df, made.kinds)

    def step_drop(self, w):
        ids = cut(w.frame.df.select(col("_c@id").alias("id")).distinct())
        self.db.graph = mutations.delete_nodes(self.db.graph, ids, True) if w.kind == "node" else mutations.delete_edges(self.db.graph, ids)
        return replace(w, frame=w.frame.with_df(w.frame.df.limit(0)))

    # -- results ---------------------------------------------------------------------------------------------------

    def result(self, w: Walk) -> DataFrame:
        if w.kind == "pairs":
            return w.frame.df
        return w.frame.df.select(self.current(w).alias("value"))


class _Everything(dict):
    """Every variable uses all its properties; Catalyst prunes what no step reads."""

    def get(self, key, default=None):
        return {"*", "@labels"}


def execute(db, text: str, params: dict | None = None) -> DataFrame:
    steps, t = parse(text), Traversal(db, params)
    # property() right after addV or addE belongs to the new element
    merged: list[Step] = []
    for s in steps:
        if s.name == "property" and merged and merged[-1].name in ("addV", "addE", "from", "to"):
            k = max(i for i, m in enumerate(merged) if m.name in ("addV", "addE"))
            props = dict(merged[k].args[1]) if len(merged[k].args) > 1 else {}
            merged[k] = Step(merged[k].name, (merged[k].args[0], tuple({**props, s.args[0]: s.args[1]}.items())))
        else:
            merged.append(s)
    out = []
    for s in merged:
        out.append(s if not (s.name in ("addV", "addE") and len(s.args) > 1) else Step(f"{s.name}With", s.args))
    return t.result(t.run(None, out))


def _with(name: str):
    def made(self, w, label, props):
        w = getattr(self, f"step_{name}")(w, label)
        w.pending[2] = dict(props)
        return w

    return made


Traversal.step_addVWith = _with("addV")
Traversal.step_addEWith = _with("addE")
