"""GraphQL over a property graph or triples. Results are flat rows, one for each path through nested fields."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..functions.scalar import QueryError
from ..plans import ir
from .lexing import Cursor, tokens

_TOKENS = re.compile(r"""(?P<skip>[\s,]+|\#[^\n]*)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<float>-?\d+\.\d+(?:[eE][+-]?\d+)?)|(?P<int>-?\d+)|(?P<param>\$\w+)|(?P<name>[A-Za-z_]\w*)|(?P<symbol>\.\.\.|[{}()\[\]:!=@|])""", re.X)

_SUFFIXES = {"_gt": ">", "_gte": ">=", "_lt": "<", "_lte": "<=", "_ne": "<>", "_in": "in", "_contains": "contains", "_starts_with": "starts", "_ends_with": "ends"}


@dataclass(frozen=True)
class Field:
    name: str
    alias: str | None
    args: tuple[tuple[str, object], ...]
    fields: tuple = ()


class Parser:
    def __init__(self, text: str, params: dict | None):
        self.c: Cursor = tokens(text, _TOKENS)
        self.params, self.fragments = dict(params or {}), {}

    def parse(self) -> tuple[str, tuple[Field, ...]]:
        c, kind, fields = self.c, None, ()
        while not c.end():
            if c.now.text == "fragment":
                c.step()
                name = c.name()
                c.name()  # on
                c.name()
                self.fragments[name] = self.selection()
            else:
                this = "query"
                if c.now.text in ("query", "mutation", "subscription"):
                    this = c.step().text
                    if c.now.kind == "name":
                        c.step()
                    if c.sym("("):
                        self.defaults()
                if this == "subscription":
                    raise QueryError("subscriptions are not supported")
                found = self.selection()
                if kind is None:
                    kind, fields = this, found
        if kind is None:
            raise QueryError("no operation")
        return kind, self.expand(fields)

    def defaults(self) -> None:
        c = self.c
        while not c.sym(")"):
            name = c.step().text[1:]
            c.need(":")
            while not c.is_sym(")", "=") and c.now.kind != "param":
                c.step()
            if c.sym("="):
                self.params.setdefault(name, self.value())

    def selection(self) -> tuple:
        c, out = self.c, []
        c.need("{")
        while not c.sym("}"):
            if c.sym("..."):
                if c.now.text == "on":
                    c.step()
                    c.name()
                    out.append(self.selection())
                else:
                    out.append(c.name())
                continue
            name, alias = c.name(), None
            if c.sym(":"):
                name, alias = c.name(), name
            args = []
            if c.sym("("):
                while not c.sym(")"):
                    key = c.name()
                    c.need(":")
                    args.append((key, self.value()))
            while c.sym("@"):
                c.name()
                if c.sym("("):
                    while not c.sym(")"):
                        c.step()
            out.append(Field(name, alias, tuple(args), self.selection() if c.is_sym("{") else ()))
        return tuple(out)

    def value(self):
        c, t = self.c, self.c.now
        if t.kind == "string":
            return c.step().text
        if t.kind == "int":
            return int(c.step().text)
        if t.kind == "float":
            return float(c.step().text)
        if t.kind == "param":
            name = c.step().text[1:]
            if name not in self.params:
                raise QueryError(f"variable ${name} has no value")
            return self.params[name]
        if c.sym("["):
            out = []
            while not c.sym("]"):
                out.append(self.value())
            return out
        if c.sym("{"):
            pairs = {}
            while not c.sym("}"):
                key = c.name()
                c.need(":")
                pairs[key] = self.value()
            return pairs
        name = c.name()
        return {"true": True, "false": False, "null": None}.get(name, name)

    def expand(self, fields: tuple) -> tuple[Field, ...]:
        """Put fragments in place."""
        out: list[Field] = []
        for f in fields:
            if isinstance(f, str):
                if f not in self.fragments:
                    raise QueryError(f"unknown fragment {f}")
                out += self.expand(self.fragments[f])
            elif isinstance(f, tuple):
                out += self.expand(f)
            else:
                out.append(replace(f, fields=self.expand(f.fields)))
        return tuple(out)


def capital(name: str) -> str:
    return name[:1].upper() + name[1:]


def _literal(v) -> ir.Expr:
    return ir.ListOf(tuple(ir.Lit(x) for x in v)) if isinstance(v, list) else ir.Lit(v)


def conditions(of, args: dict) -> list[ir.Expr]:
    """``of(key)`` gives a field's expression. Suffixes choose the comparison; ``where`` nests more."""
    out = []
    for key, v in args.items():
        if key in ("first", "limit", "skip", "offset", "orderBy"):
            continue
        if key in ("where", "filter") and isinstance(v, dict):
            out += conditions(of, v)
            continue
        suffix = next((s for s in sorted(_SUFFIXES, key=len, reverse=True) if key.endswith(s)), None)
        out.append(ir.Op(_SUFFIXES[suffix], (of(key[: -len(suffix)]), _literal(v))) if suffix else ir.Op("=", (of(key), _literal(v))))
    return out


def _all(parts: list[ir.Expr]) -> ir.Expr | None:
    out = None
    for p in parts:
        out = p if out is None else ir.Op("and", (out, p))
    return out


def _order(args: dict, of) -> tuple[ir.SortKey, ...]:
    keys = args.get("orderBy")
    if keys is None:
        return ()
    pairs = keys.items() if isinstance(keys, dict) else [(k, "ASC") for k in (keys if isinstance(keys, list) else [keys])]
    return tuple(ir.SortKey(of(k), str(way).upper() == "DESC") for k, way in pairs)


class Builder:
    """Nodes and edges of the pattern, and the items to return."""

    def __init__(self):
        self.paths: list[ir.Path] = []
        self.where: list[ir.Expr] = []
        self.items: list[ir.Item] = []
        self.n = 0

    def fields(self, var: str, fields: tuple[Field, ...], prefix: str) -> None:
        for f in fields:
            name = prefix + (f.alias or f.name)
            if f.fields:
                self.n += 1
                child = f"_n{self.n}"
                self.paths.append(ir.Path((ir.NodePat(var), ir.NodePat(child)), (ir.EdgePat(f"_e{self.n}", (f.name,), anonymous=True),)))
                self.where += conditions(lambda k, v=child: ir.Prop(ir.Var(v), k), dict(f.args))
                self.fields(child, f.fields, name + "_")
            elif f.name == "id":
                self.items.append(ir.Item(ir.Call("id", (ir.Var(var),)), name))
            elif f.name == "__typename":
                self.items.append(ir.Item(ir.Index(ir.Call("labels", (ir.Var(var),)), ir.Lit(0)), name))
            else:
                self.items.append(ir.Item(ir.Prop(ir.Var(var), f.name), name))


def label_of(graph, name: str) -> str:
    """``user`` and ``users`` both mean the label User."""
    wanted = capital(name)
    known = graph.labels()
    return wanted if wanted in known or not (wanted.endswith("s") and wanted[:-1] in known) else wanted[:-1]


def query_plan(graph, f: Field) -> ir.Operator:
    b, args = Builder(), dict(f.args)
    of = lambda k: ir.Call("id", (ir.Var("_n0"),)) if k == "id" else ir.Prop(ir.Var("_n0"), k)
    b.where += conditions(of, args)
    b.fields("_n0", f.fields, "")
    first = ir.Path((ir.NodePat("_n0", (label_of(graph, f.name),)),), ())
    plan: ir.Operator = ir.Match(ir.Start(), (first, *b.paths), _all(b.where))
    size, skip = args.get("first", args.get("limit")), args.get("skip", args.get("offset"))
    return ir.Project(plan, tuple(b.items), order=_order(args, of), skip=None if skip is None else ir.Lit(skip), limit=None if size is None else ir.Lit(size), final=True)


def mutation_plan(f: Field) -> ir.Operator:
    verb = next((v for v in ("create", "update", "delete") if f.name.startswith(v) and len(f.name) > len(v)), None)
    if verb is None:
        raise QueryError(f"unknown mutation {f.name}")
    label, args = capital(f.name[len(verb) :]), dict(f.args)
    values = args.get("input", args.get("data"))
    b = Builder()
    b.fields("_n0", f.fields, "")
    if verb == "create":
        props = tuple((k, _literal(v)) for k, v in (values if isinstance(values, dict) else args).items())
        plan: ir.Operator = ir.Create(ir.Start(), (ir.Path((ir.NodePat("_n0", (label,), props),), ()),))
    else:
        of = lambda k: ir.Call("id", (ir.Var("_n0"),)) if k == "id" else ir.Prop(ir.Var("_n0"), k)
        keys = {k: v for k, v in args.items() if k in ("id", "where", "filter")} or dict(list(args.items())[:1])
        plan = ir.Match(ir.Start(), (ir.Path((ir.NodePat("_n0", (label,)),), ()),), _all(conditions(of, keys)))
        if verb == "update":
            changes = values if isinstance(values, dict) else {k: v for k, v in args.items() if k not in keys}
            plan = ir.SetItems(plan, tuple(("_n0", k, _literal(v), "merge") for k, v in changes.items()))
        else:
            plan = ir.Delete(plan, ("_n0",), True)
    return ir.Project(plan, tuple(b.items) or (ir.Item(ir.Call("id", (ir.Var("_n0"),)), "id"),), final=True)


def execute(db, text: str, params: dict | None = None) -> DataFrame:
    """Root fields run one after another; the rows of the first are the result, as fields differ."""
    kind, fields = Parser(text, params).parse()
    if kind == "mutation":
        results = [db._run(mutation_plan(f), params) for f in fields]
        return results[0]
    return db._run(query_plan(db.graph, fields[0]), params)


def execute_rdf(db, text: str, params: dict | None = None, namespace: str = "http://example.org/") -> DataFrame:
    """A field is a predicate, the root a class; the query becomes SPARQL text."""
    kind, fields = Parser(text, params).parse()
    if kind != "query":
        raise QueryError("only queries run over triples")
    f = fields[0]
    lines, wanted, n = [f"?n0 a <{namespace}{capital(f.name)}> ."], [], 0

    def show(v) -> str:
        if isinstance(v, str):
            return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
        return str(v).lower() if isinstance(v, bool) else str(v)

    def filters(var: str, args: dict) -> None:
        nonlocal n
        for key, v in args.items():
            if key in ("first", "limit", "skip", "offset", "orderBy"):
                continue
            if key in ("where", "filter") and isinstance(v, dict):
                filters(var, v)
                continue
            suffix = next((s for s in sorted(_SUFFIXES, key=len, reverse=True) if key.endswith(s)), None)
            n += 1
            x, name = f"?f{n}", key[: -len(suffix)] if suffix else key
            lines.append(f"{var} <{namespace}{name}> {x} .")
            op = _SUFFIXES[suffix] if suffix else "="
            test = {"in": f"{x} IN ({', '.join(map(show, v if isinstance(v, list) else [v]))})", "contains": f"CONTAINS(STR({x}), {show(v)})", "starts": f"STRSTARTS(STR({x}), {show(v)})", "ends": f"STRENDS(STR({x}), {show(v)})"}.get(op, f"{x} {'!=' if op == '<>' else op} {show(v)}")
            lines.append(f"FILTER({test})")

    def nested(var: str, fields: tuple[Field, ...], prefix: str) -> None:
        nonlocal n
        for g in fields:
            name = prefix + (g.alias or g.name)
            if g.name == "id" and not g.fields:
                lines.append(f"BIND(STR({var}) AS ?{name})")
                wanted.append(name)
                continue
            if g.fields:
                n += 1
                child = f"?c{n}"
                lines.append(f"{var} <{namespace}{g.name}> {child} .")
                filters(child, dict(g.args))
                nested(child, g.fields, name + "_")
            else:
                lines.append(f"{var} <{namespace}{g.name}> ?{name} .")
                wanted.append(name)

    args = dict(f.args)
    filters("?n0", args)
    nested("?n0", f.fields, "")
    tail = ""
    if "orderBy" in args:
        keys = args["orderBy"]
        pairs = keys.items() if isinstance(keys, dict) else [(k, "ASC") for k in (keys if isinstance(keys, list) else [keys])]
        tail += " ORDER BY " + " ".join(f"{'DESC' if str(way).upper() == 'DESC' else 'ASC'}(?{k})" for k, way in pairs)
    if (size := args.get("first", args.get("limit"))) is not None:
        tail += f" LIMIT {size}"
    if (skip := args.get("skip", args.get("offset"))) is not None:
        tail += f" OFFSET {skip}"
    return db.execute_sparql(f"SELECT {' '.join('?' + w for w in wanted)} WHERE {{ {' '.join(lines)} }}{tail}")
