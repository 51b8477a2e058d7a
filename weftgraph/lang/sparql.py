"""SPARQL 1.1 over a triple store.

Solutions are a DataFrame with a column for each variable: a term struct, or a plain value that an expression
made. A basic graph pattern is a chain of joins on shared variables, each over triples filtered by the
constants of the pattern. Variables that an OPTIONAL or a UNION may leave unbound join by compatibility.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import QueryError
from ..plans.lineage import cut
from ..sources import rdf
from ..sources.rdf import XSD, TripleStore
from .lexing import Cursor, tokens

_TOKENS = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<string>\"{3}.*?\"{3}|'{3}.*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<float>\d*\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
    |(?P<int>\d+)
    |(?P<param>[?$]\w+)
    |(?P<bnode>_:\w+)
    |(?P<pname>(?:[A-Za-z][\w-]*)?:(?:[\w%-](?:[\w.%-]*[\w%-])?)?)
    |(?P<name>[A-Za-z]\w*)
    |(?P<symbol>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!+*/|^?-])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class V:
    name: str


@dataclass(frozen=True)
class T:
    kind: str
    value: str
    datatype: str = ""
    lang: str = ""

    def column(self) -> Column:
        return rdf.term(self.kind, self.value, self.datatype, self.lang).cast(rdf.TERM)


@dataclass(frozen=True)
class PathExpr:
    op: str  # iri, inv, seq, alt, star, plus, opt, neg
    args: tuple = ()


@dataclass
class Group:
    parts: list = field(default_factory=list)  # (kind, ...)


@dataclass
class Select:
    items: list = field(default_factory=list)  # (expr or None, name)
    star: bool = False
    distinct: bool = False
    where: Group | None = None
    group: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    values: tuple | None = None


AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


class Parser:
    def __init__(self, text: str):
        self.c: Cursor = tokens(text, _TOKENS)
        self.prefixes: dict[str, str] = {}
        self.base, self.n = "", 0

    # -- terms -----------------------------------------------------------------------------------------

    def prologue(self) -> None:
        c = self.c
        while True:
            if c.word("PREFIX"):
                name = c.step().text[:-1]
                self.prefixes[name] = c.step().text[1:-1]
            elif c.word("BASE"):
                self.base = c.step().text[1:-1]
            else:
                return

    def resolved(self, raw: str) -> str:
        return raw if re.match(r"[A-Za-z][\w+.-]*:", raw) else self.base + raw

    def fresh(self) -> V:
        self.n += 1
        return V(f"_b{self.n}")

    def iri(self) -> str:
        t = self.c.step()
        if t.kind == "iri":
            return self.resolved(t.text[1:-1])
        if t.kind == "pname":
            prefix, _, local = t.text.partition(":")
            if prefix not in self.prefixes:
                raise QueryError(f"unknown prefix {prefix}:")
            return self.prefixes[prefix] + local
        if t.kind == "name" and t.text == "a":
            return rdf.TYPE
        self.c.at -= 1
        self.c.fail("expected an IRI")

    def term(self):
        c, t = self.c, self.c.now
        if t.kind == "param":
            return V(c.step().text[1:])
        if t.kind == "bnode":
            return V("_" + c.step().text[2:])
        if t.kind == "string":
            text = c.step().text
            if text.startswith('""') and self.c.text[t.at : t.at + 3] in ('"""', "'''"):
                text = text[2:-2]
            if c.now.kind == "lang":
                return T("lit", text, "", c.step().text[1:].lower())
            if c.sym("^^"):
                kind = self.iri()
                return T("lit", text, "" if kind == XSD + "string" else kind)
            return T("lit", text)
        sign = ""
        if c.is_sym("-", "+") and c.ahead().kind in ("int", "float"):
            sign = c.step().text.replace("+", "")
        if c.now.kind == "int":
            return T("lit", sign + c.step().text, XSD + "integer")
        if c.now.kind == "float":
            return T("lit", sign + c.step().text, XSD + "decimal")
        if c.is_word("TRUE", "FALSE"):
            return T("lit", c.step().text.lower(), XSD + "boolean")
        return T("iri", self.iri())

    # -- patterns -----------------------------------------------------------------------------------------

    def triples(self, out: list, stop: tuple[str, ...] = ("}",)) -> None:
        """One subject with its predicates and objects."""
        c = self.c
        if c.sym("["):
            s = self.fresh()
            if not c.sym("]"):
                self.predicates(s, out)
                c.need("]")
        else:
            s = self.term()
        if not c.is_sym(".", *stop):
            self.predicates(s, out)

    def predicates(self, s, out: list) -> None:
        c = self.c
        while True:
            p = V(c.step().text[1:]) if c.now.kind == "param" else self.path()
            while True:
                if c.sym("["):
                    o = self.fresh()
                    if not c.sym("]"):
                        self.predicates(o, out)
                        c.need("]")
                else:
                    o = self.term()
                out.append((s, p, o))
                if not c.sym(","):
                    break
            if not c.sym(";"):
                return
            while c.sym(";"):
                pass
            if c.is_sym(".", "}", "]"):
                return

    def path(self):
        parts = [self.path_seq()]
        while self.c.sym("|"):
            parts.append(self.path_seq())
        return parts[0] if len(parts) == 1 else PathExpr("alt", tuple(parts))

    def path_seq(self):
        parts = [self.path_elt()]
        while self.c.sym("/"):
            parts.append(self.path_elt())
        return parts[0] if len(parts) == 1 else PathExpr("seq", tuple(parts))

    def path_elt(self):
        c = self.c
        if c.sym("^"):
            return PathExpr("inv", (self.path_elt(),))
        if c.sym("!"):
            many = c.sym("(")
            parts = []
            while True:
                back = c.sym("^")
                parts.append((self.iri(), back))
                if not (many and c.sym("|")):
                    break
            if many:
                c.need(")")
            p = PathExpr("neg", tuple(parts))
        elif c.sym("("):
            p = self.path()
            c.need(")")
        else:
            p = PathExpr("iri", (self.iri(),))
        if c.sym("*"):
            return PathExpr("star", (p,))
        if c.sym("+"):
            return PathExpr("plus", (p,))
        if c.is_sym("?"):
            c.step()
            return PathExpr("opt", (p,))
        return p

    def group(self) -> Group:
        c, g = self.c, Group()
        c.need("{")
        if c.is_word("SELECT"):
            g.parts.append(("select", self.select()))
            c.need("}")
            return g
        bgp: list = []

        def close() -> None:
            nonlocal bgp
            if bgp:
                g.parts.append(("bgp", bgp))
                bgp = []

        while not c.sym("}"):
            if c.sym("."):
                continue
            if c.word("OPTIONAL"):
                close()
                g.parts.append(("optional", self.group()))
            elif c.word("MINUS"):
                close()
                g.parts.append(("minus", self.group()))
            elif c.word("FILTER"):
                g.parts.append(("filter", self.constraint()))
            elif c.word("BIND"):
                close()
                c.need("(")
                e = self.expr()
                c.need_word("AS")
                g.parts.append(("bind", e, c.step().text[1:]))
                c.need(")")
            elif c.word("VALUES"):
                close()
                g.parts.append(("values", self.data()))
            elif c.word("GRAPH"):
                close()
                name = V(c.step().text[1:]) if c.now.kind == "param" else T("iri", self.iri())
                g.parts.append(("graph", name, self.group()))
            elif c.word("SERVICE"):
                raise QueryError("SERVICE is not supported")
            elif c.is_sym("{"):
                close()
                alternatives = [self.group()]
                while c.word("UNION"):
                    alternatives.append(self.group())
                g.parts.append(("union", alternatives))
            else:
                self.triples(bgp)
        close()
        return g

    def data(self) -> tuple[list[str], list[list]]:
        c, names = self.c, []
        one = c.now.kind == "param"
        if one:
            names = [c.step().text[1:]]
        else:
            c.need("(")
            while not c.sym(")"):
                names.append(c.step().text[1:])
        c.need("{")
        rows = []
        while not c.sym("}"):
            row = []
            if not one:
                c.need("(")
            while not c.is_sym(")") and not (one and row):
                row.append(None if c.word("UNDEF") else self.term())
            if not one:
                c.need(")")
            rows.append(row)
        return names, rows

    # -- queries ----------------------------------------------------------------------------------------------

    def select(self) -> Select:
        c, s = self.c, Select()
        c.need_word("SELECT")
        s.distinct = c.word("DISTINCT") or c.word("REDUCED")
        if c.sym("*"):
            s.star = True
        else:
            while c.now.kind == "param" or c.is_sym("("):
                if c.sym("("):
                    e = self.expr()
                    c.need_word("AS")
                    s.items.append((e, c.step().text[1:]))
                    c.need(")")
                else:
                    s.items.append((None, c.step().text[1:]))
        while c.word("FROM"):
            c.word("NAMED")
            self.iri()
        c.word("WHERE")
        s.where = self.group()
        self.modifiers(s)
        return s

    def modifiers(self, s: Select) -> None:
        c = self.c
        while True:
            if c.word("GROUP", "BY"):
                while c.now.kind == "param" or c.is_sym("(") or (c.now.kind == "name" and c.ahead().text == "(" and not c.is_word("HAVING", "ORDER", "VALUES")):
                    if c.sym("("):
                        e = self.expr()
                        name = None
                        if c.word("AS"):
                            name = c.step().text[1:]
                        c.need(")")
                        s.group.append((e, name or f"_g{len(s.group)}"))
                    elif c.now.kind == "param":
                        name = c.step().text[1:]
                        s.group.append((("var", name), name))
                    else:
                        s.group.append((self.expr(), f"_g{len(s.group)}"))
            elif c.word("HAVING"):
                while c.is_sym("("):
                    s.having.append(self.constraint())
            elif c.word("ORDER", "BY"):
                while c.now.kind == "param" or c.is_sym("(") or c.is_word("ASC", "DESC") or (c.now.kind == "name" and c.ahead().text == "(" and not c.is_word("HAVING", "ORDER", "VALUES")):
                    down = c.word("DESC")
                    if not down:
                        c.word("ASC")
                    s.order.append((self.constraint() if c.is_sym("(") else self.expr(), down))
            elif c.word("LIMIT"):
                s.limit = int(c.step().text)
            elif c.word("OFFSET"):
                s.offset = int(c.step().text)
            elif c.word("VALUES"):
                s.values = self.data()
            else:
                return

    # -- expressions --------------------------------------------------------------------------------------------

    def constraint(self):
        c = self.c
        if c.sym("("):
            e = self.expr()
            c.need(")")
            return e
        return self.primary()

    def expr(self):
        e = self.conj()
        while self.c.sym("||"):
            e = ("or", e, self.conj())
        return e

    def conj(self):
        e = self.rel()
        while self.c.sym("&&"):
            e = ("and", e, self.rel())
        return e

    def rel(self):
        c, e = self.c, self.add()
        if c.is_sym("=", "!=", "<", ">", "<=", ">="):
            op = c.step().text
            return ("cmp", op, e, self.add())
        if c.word("IN"):
            return ("in", e, self.arguments())
        if c.word("NOT", "IN"):
            return ("not", ("in", e, self.arguments()))
        return e

    def add(self):
        e = self.mul()
        while self.c.is_sym("+", "-"):
            op = self.c.step().text
            e = ("math", op, e, self.mul())
        return e

    def mul(self):
        e = self.unary()
        while self.c.is_sym("*", "/"):
            op = self.c.step().text
            e = ("math", op, e, self.unary())
        return e

    def unary(self):
        c = self.c
        if c.sym("!"):
            return ("not", self.unary())
        if c.is_sym("-") and c.ahead().kind not in ("int", "float"):
            c.step()
            return ("math", "-", ("term", T("lit", "0", XSD + "integer")), self.unary())
        return self.primary()

    def arguments(self) -> list:
        c, out = self.c, []
        c.need("(")
        while not c.sym(")"):
            out.append(self.expr())
            c.sym(",")
        return out

    def primary(self):
        c, t = self.c, self.c.now
        if c.sym("("):
            e = self.expr()
            c.need(")")
            return e
        if t.kind == "param":
            return ("var", c.step().text[1:])
        if c.word("NOT", "EXISTS"):
            return ("not", ("exists", self.group()))
        if c.word("EXISTS"):
            return ("exists", self.group())
        if t.kind == "name" and t.text.upper() in AGGREGATES and c.ahead().text == "(":
            name = c.step().text.upper()
            c.need("(")
            distinct, arg, sep = c.word("DISTINCT"), None, " "
            if not c.sym("*"):
                arg = self.expr()
            if c.sym(";"):
                c.need_word("SEPARATOR")
                c.need("=")
                sep = c.step().text
            c.need(")")
            return ("agg", name, distinct, arg, sep)
        if t.kind == "name" and t.text.upper() not in ("TRUE", "FALSE", "A") and c.ahead().text == "(":
            name = c.step().text.upper()
            return ("call", name, self.arguments())
        if t.kind in ("iri", "pname"):
            name = self.iri()
            if c.is_sym("("):
                return ("cast", name, self.arguments())
            return ("term", T("iri", name))
        return ("term", self.term())


# -- evaluation -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Sols:
    """Solutions. ``kinds``: term, num, int, str or bool for each variable; ``loose``: may be unbound."""

    df: DataFrame
    kinds: dict
    loose: frozenset = frozenset()


@dataclass(frozen=True)
class Val:
    c: Column
    kind: str  # term, num, int, str, bool


def own(name: str) -> Column:
    return F.col(f"`{name}`")


class Engine:
    def __init__(self, spark: SparkSession, store: TripleStore, graph=None):
        self.spark, self.store, self.graph = spark, store, graph

    # values ----------------------------------------------------------------------------------------

    def num(self, v: Val) -> Column:
        if v.kind == "term":
            return F.when(v.c["kind"] == "lit", v.c["value"].try_cast("double"))
        return v.c.cast("double") if v.kind in ("num", "int") else v.c.try_cast("double") if v.kind == "str" else v.c.cast("double")

    def text(self, v: Val) -> Column:
        return v.c["value"] if v.kind == "term" else v.c.cast("string")

    def truth(self, v: Val) -> Column:
        if v.kind == "bool":
            return v.c
        if v.kind in ("num", "int"):
            return v.c != 0
        if v.kind == "str":
            return F.length(v.c) > 0
        number = self.num(v)
        return F.when(v.c["datatype"] == XSD + "boolean", v.c["value"].isin("true", "1")).when(number.isNotNull(), number != 0).otherwise(F.length(v.c["value"]) > 0)

    def compare(self, op: str, a: Val, b: Val) -> Column:
        """Numbers by value; otherwise terms for equality and text for order."""
        x, y = self.num(a), self.num(b)
        both = x.isNotNull() & y.isNotNull()
        if op in ("=", "!="):
            if a.kind == b.kind == "term":
                plain = a.c == b.c
            elif a.kind == "bool" or b.kind == "bool":
                plain = self.truth(a) == self.truth(b)
            else:
                plain = self.text(a) == self.text(b)
            equal = F.when(both, x == y).otherwise(plain)
            return equal if op == "=" else ~equal
        s, t = self.text(a), self.text(b)
        order = {"<": (x < y, s < t), "<=": (x <= y, s <= t), ">": (x > y, s > t), ">=": (x >= y, s >= t)}[op]
        return F.when(both, order[0]).otherwise(order[1])

    def value(self, s: Sols, e) -> Val:
        go = lambda x: self.value(s, x)
        match e[0]:
            case "var":
                if e[1] not in s.kinds:
                    return Val(F.lit(None).cast(rdf.TERM), "term")
                return Val(own(e[1]), s.kinds[e[1]])
            case "term":
                return Val(e[1].column(), "term")
            case "or":
                return Val(self.truth(go(e[1])) | self.truth(go(e[2])), "bool")
            case "and":
                return Val(self.truth(go(e[1])) & self.truth(go(e[2])), "bool")
            case "not":
                return Val(~self.truth(go(e[1])), "bool")
            case "cmp":
                return Val(self.compare(e[1], go(e[2]), go(e[3])), "bool")
            case "in":
                tests = [self.compare("=", go(e[1]), go(x)) for x in e[2]]
                return Val(reduce(lambda a, b: a | b, tests, F.lit(False)), "bool")
            case "math":
                a, b = go(e[2]), go(e[3])
                x, y = self.num(a), self.num(b)
                return Val({"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[e[1]], "num")
            case "cast":
                return self.cast(e[1], go(e[2][0]))
            case "call":
                return self.call(s, e[1], e[2])
            case "slot":
                return Val(own(e[1]), e[2])
        raise QueryError(f"cannot evaluate {e[0]} here")

    def cast(self, name: str, v: Val) -> Val:
        kind = name.removeprefix(XSD)
        if kind in ("integer", "int", "long"):
            return Val(F.floor(self.num(v)).cast("bigint"), "int")
        if kind in ("double", "float", "decimal"):
            return Val(self.num(v), "num")
        if kind == "string":
            return Val(self.text(v), "str")
        if kind == "boolean":
            return Val(self.truth(v), "bool")
        raise QueryError(f"unknown function <{name}>")

    def call(self, s: Sols, name: str, args: list) -> Val:
        if name == "BOUND":
            return Val(own(args[0][1]).isNotNull() if args[0][1] in s.kinds else F.lit(False), "bool")
        v = [self.value(s, a) for a in args]
        if name == "IF":
            a, b = self.alike(v[1], v[2])
            return Val(F.when(self.truth(v[0]), a.c).otherwise(b.c), a.kind)
        if name == "COALESCE":
            same = v if len({x.kind for x in v}) == 1 else [Val(self.text(x), "str") for x in v]
            return Val(F.coalesce(*[x.c for x in same]), same[0].kind)
        t = [self.text(x) for x in v]
        text = {
            "STR": lambda: t[0], "UCASE": lambda: F.upper(t[0]), "LCASE": lambda: F.lower(t[0]), "CONCAT": lambda: F.concat(*t),
            "SUBSTR": lambda: F.substr(t[0], self.num(v[1]).cast("int"), *([self.num(v[2]).cast("int")] if len(v) > 2 else [])),
            "ENCODE_FOR_URI": lambda: F.replace(F.url_encode(t[0]), F.lit("+"), F.lit("%20")),
            "REPLACE": lambda: F.regexp_replace(t[0], t[1], t[2]), "MD5": lambda: F.md5(t[0].cast("binary")), "SHA1": lambda: F.sha1(t[0].cast("binary")),
            "SHA256": lambda: F.sha2(t[0], 256), "SHA384": lambda: F.sha2(t[0], 384), "SHA512": lambda: F.sha2(t[0], 512),
            "UUID": lambda: F.concat(F.lit("urn:uuid:"), F.uuid()), "STRUUID": lambda: F.uuid(),
            "LANG": lambda: v[0].c["lang"] if v[0].kind == "term" else F.lit(""), "TZ": lambda: F.regexp_extract(t[0], r"(Z|[+-]\d\d:\d\d)$", 1), "TIMEZONE": lambda: F.regexp_extract(t[0], r"(Z|[+-]\d\d:\d\d)$", 1),
            "NOW": lambda: F.current_timestamp().cast("string"),
        }
        at = lambda a, b: F.position(b, a)
        if name == "STRBEFORE":
            return Val(F.when(F.contains(t[0], t[1]), F.left(t[0], at(t[0], t[1]) - 1)).otherwise(""), "str")
        if name == "STRAFTER":
            return Val(F.when(F.contains(t[0], t[1]), F.substr(t[0], at(t[0], t[1]) + F.length(t[1]))).otherwise(""), "str")
        if name == "DATATYPE":
            c = v[0].c
            plain = F.when(c["datatype"] != "", c["datatype"]).otherwise(XSD + "string") if v[0].kind == "term" else F.lit(XSD + {"num": "double", "int": "integer", "str": "string", "bool": "boolean"}[v[0].kind])
            return Val(plain, "str")
        if name in text:
            return Val(text[name](), "str")
        number = {"ABS": F.abs, "ROUND": F.round, "CEIL": F.ceil, "FLOOR": F.floor}
        if name in number:
            return Val(number[name](self.num(v[0])).cast("double"), "num")
        if name == "RAND":
            return Val(F.rand(), "num")
        parts = {"YEAR": F.year, "MONTH": F.month, "DAY": F.day, "HOURS": F.hour, "MINUTES": F.minute, "SECONDS": F.second}
        if name in parts:
            return Val(parts[name](F.try_to_timestamp(t[0])).cast("bigint"), "int")
        if name == "STRLEN":
            return Val(F.length(t[0]).cast("bigint"), "int")
        tests = {
            "STRSTARTS": lambda: F.startswith(t[0], t[1]), "STRENDS": lambda: F.endswith(t[0], t[1]), "CONTAINS": lambda: F.contains(t[0], t[1]),
            "LANGMATCHES": lambda: F.when(t[1] == "*", t[0] != "").otherwise((F.lower(t[0]) == F.lower(t[1])) | F.startswith(F.lower(t[0]), F.concat(F.lower(t[1]), F.lit("-")))),
            "ISIRI": lambda: self.is_kind(v[0], "iri"), "ISURI": lambda: self.is_kind(v[0], "iri"), "ISBLANK": lambda: self.is_kind(v[0], "bnode"),
            "ISLITERAL": lambda: self.is_kind(v[0], "lit"), "SAMETERM": lambda: v[0].c == v[1].c,
            "ISNUMERIC": lambda: (v[0].c["datatype"].startswith(XSD) & self.num(v[0]).isNotNull()) if v[0].kind == "term" else F.lit(v[0].kind in ("num", "int")),
        }
        if name in tests:
            return Val(tests[name](), "bool")
        if name == "REGEX":
            flags = F.concat(F.lit("(?"), t[2], F.lit(")")) if len(t) > 2 else F.lit("")
            return Val(F.rlike(t[0], F.concat(flags, t[1])), "bool")
        terms = {"IRI": lambda: rdf.iri(t[0]), "URI": lambda: rdf.iri(t[0]), "BNODE": lambda: rdf.term("bnode", t[0] if t else F.uuid()), "STRDT": lambda: rdf.term("lit", t[0], t[1]), "STRLANG": lambda: rdf.term("lit", t[0], "", t[1])}
        if name in terms:
            return Val(terms[name]().cast(rdf.TERM), "term")
        raise QueryError(f"unknown function {name}")

    @staticmethod
    def is_kind(v: Val, kind: str) -> Column:
        return v.c["kind"] == kind if v.kind == "term" else F.lit(kind == "lit")

    def alike(self, a: Val, b: Val) -> tuple[Val, Val]:
        if a.kind == b.kind:
            return a, b
        if {a.kind, b.kind} <= {"num", "int"}:
            return Val(self.num(a), "num"), Val(self.num(b), "num")
        return Val(self.text(a), "str"), Val(self.text(b), "str")

    # patterns -------------------------------------------------------------------------------------------

    def scan(self, s, p, o) -> Sols:
        """Solutions of one triple pattern."""
        if isinstance(p, PathExpr) and p.op != "iri":
            pairs = self.path(p)
            if p.op in ("star", "opt"):
                pairs = self.reflexive(pairs, s, o)
            df, ends = pairs, [("s", s), ("o", o)]
        else:
            df, ends = self.triples(), [("s", s), ("p", p), ("o", o)]
        wanted: dict[str, Column] = {}
        for c, x in ends:
            if isinstance(x, PathExpr):
                df = df.where(F.col("p") == x.args[0])
            elif isinstance(x, T):
                df = df.where((F.col("p") == x.value) if c == "p" else self.is_term(F.col(c), x))
            else:
                at = rdf.iri(F.col("p")).cast(rdf.TERM) if c == "p" else F.col(c)
                if x.name in wanted:
                    df = df.where(wanted[x.name] == at)
                else:
                    wanted[x.name] = at
        if isinstance(self.graph, V):
            wanted.setdefault(self.graph.name, rdf.iri(F.col("g")).cast(rdf.TERM))
        df = df.select(*[c.alias(n) for n, c in wanted.items()]) if wanted else df.select(F.lit(1).alias("_one"))
        return Sols(df, {n: "term" for n in wanted})

    @staticmethod
    def is_term(c: Column, t: T) -> Column:
        """Field by field, so that the scan can prune by value."""
        return (c["value"] == t.value) & (c["kind"] == t.kind) & (c["datatype"] == t.datatype) & (c["lang"] == t.lang)

    def triples(self) -> DataFrame:
        if isinstance(self.graph, V):
            return self.store.df.where("g <> ''")
        return self.store.of(self.graph.value if self.graph else None)

    def path(self, p: PathExpr) -> DataFrame:
        """Pairs ``s, o`` of a property path, without zero-length ones."""
        match p.op:
            case "iri":
                return self.triples().where(F.col("p") == p.args[0]).select("s", "o")
            case "inv":
                return self.path(p.args[0]).select(F.col("o").alias("s"), F.col("s").alias("o"))
            case "seq":
                out = self.whole(p.args[0])
                for q in p.args[1:]:
                    nxt = self.whole(q).select(F.col("s").alias("m"), F.col("o").alias("e"))
                    out = out.join(nxt, F.col("o") == F.col("m")).select("s", F.col("e").alias("o"))
                return out
            case "alt":
                return reduce(DataFrame.unionAll, [self.path(q) for q in p.args])
            case "neg":
                t = self.triples()
                ahead = [i for i, back in p.args if not back]
                behind = [i for i, back in p.args if back]
                parts = []
                if ahead or not behind:
                    parts.append(t.where(~F.col("p").isin(*ahead)).select("s", "o"))
                if behind:
                    parts.append(t.where(~F.col("p").isin(*behind)).select(F.col("o").alias("s"), F.col("s").alias("o")))
                return reduce(DataFrame.unionAll, parts)
            case "opt":
                return self.path(p.args[0]).distinct()
            case "plus" | "star":
                return closure(self.path(p.args[0]))
        raise QueryError(f"unknown path {p.op}")

    def whole(self, p: PathExpr) -> DataFrame:
        pairs = self.path(p)
        return self.reflexive(pairs, V("s"), V("o")) if p.op in ("star", "opt") else pairs

    def reflexive(self, pairs: DataFrame, s, o) -> DataFrame:
        """Add zero-length paths: of every node, or of the one end that is given."""
        given = next((x for x in (s, o) if isinstance(x, T)), None)
        t = self.triples()
        nodes = self.spark.range(1).select(given.column().alias("s")) if given else t.select("s").unionAll(t.select(F.col("o").alias("s"))).distinct()
        return pairs.unionAll(nodes.select("s", F.col("s").alias("o"))).distinct()

    def join(self, a: Sols, b: Sols, how: str = "inner") -> Sols:
        shared = [v for v in a.kinds if v in b.kinds]
        loose = [v for v in shared if v in a.loose or v in b.loose]
        kinds = {**b.kinds, **a.kinds}
        new_loose = (a.loose | b.loose) - frozenset(v for v in shared if v not in (a.loose & b.loose))
        if how == "left":
            new_loose = a.loose | frozenset(v for v in b.kinds if v not in a.kinds) | (b.loose - frozenset(a.kinds))
        right = b.df.select(*[own(v).alias(f"_r_{v}") for v in b.kinds]) if b.kinds else b.df.select(F.lit(1).alias("_r"))
        if loose and len(loose) == len(shared):
            df = self.loose_join(a.df, right, shared, how)
        else:
            meet = [self.meets(v, v in loose) for v in shared]
            df = a.df.join(right, reduce(lambda x, y: x & y, meet, F.lit(True)), how) if shared or how != "inner" else a.df.crossJoin(right)
        out = [(F.coalesce(own(v), own(f"_r_{v}")) if v in loose else own(v)).alias(v) if v in a.kinds else own(f"_r_{v}").alias(v) for v in kinds]
        return Sols(df.select(*out) if out else df.select(F.lit(1).alias("_one")), kinds, new_loose)

    @staticmethod
    def meets(v: str, loose: bool) -> Column:
        same = own(v) == own(f"_r_{v}")
        return same | own(v).isNull() | own(f"_r_{v}").isNull() if loose else same

    def loose_join(self, left: DataFrame, right: DataFrame, shared: list[str], how: str) -> DataFrame:
        """A join in which every shared variable may be unbound. Rows that bind all of them meet by an equi-join;
        only rows that leave one open, mostly few or none, are compared with all."""
        both = lambda x, y: x & y
        bound = [reduce(both, [own(f"{p}{v}").isNotNull() for v in shared]) for p in ("", "_r_")]
        (a, a_open), (b, b_open) = ((df.where(c), df.where(~c)) for df, c in zip((left, right), bound))
        same, maybe = (reduce(both, [self.meets(v, x) for v in shared]) for x in (False, True))
        parts = [a.join(b, same), a.join(b_open, maybe), a_open.join(right, maybe)]
        if how == "left":
            parts += [a.join(b, same, "left_anti").join(b_open, maybe, "left_anti"), a_open.join(right, maybe, "left_anti")]
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)

    def unit(self) -> Sols:
        return Sols(self.spark.range(1).select(F.lit(1).alias("_one")), {})

    def bgp(self, patterns: list) -> Sols:
        """Joins in an order in which each pattern shares a variable with those before, constants first."""
        fixed = lambda t: sum(isinstance(x, T) for x in (t[0], t[2]))
        todo, out, seen = sorted(patterns, key=lambda t: -fixed(t)), None, set()
        while todo:
            k = next((i for i, t in enumerate(todo) if out is None or any(isinstance(x, V) and x.name in seen for x in t)), 0)
            t = todo.pop(k)
            found = self.scan(*t)
            out = found if out is None else self.join(out, found)
            seen |= {x.name for x in t if isinstance(x, V)}
        return out or self.unit()

    def solve(self, g: Group) -> Sols:
        s, filters = None, []
        step = lambda found: found if s is None else self.join(s, found)
        for part in g.parts:
            match part[0]:
                case "bgp":
                    s = step(self.bgp(part[1]))
                case "optional":
                    s = self.optional(s or self.unit(), part[1])
                case "minus":
                    s = self.minus(s or self.unit(), self.solve(part[1]))
                case "filter":
                    filters.append(part[1])
                case "bind":
                    s = s or self.unit()
                    v = self.value(s, part[1])
                    s = Sols(s.df.withColumn(part[2], v.c), {**s.kinds, part[2]: v.kind}, s.loose | {part[2]})
                case "values":
                    s = step(self.inline(*part[1]))
                case "graph":
                    s = step(Engine(self.spark, self.store, part[1]).solve(part[2]))
                case "union":
                    s = step(self.union([self.solve(x) for x in part[1]]))
                case "select":
                    s = step(self.select(part[1]))
        s = s or self.unit()
        for e in filters:
            s = self.filter(s, e)
        return s

    def filter(self, s: Sols, e) -> Sols:
        if e[0] == "and":
            return self.filter(self.filter(s, e[1]), e[2])
        negated = e[0] == "not" and e[1][0] == "exists"
        if e[0] == "exists" or negated:
            inner = self.solve(e[1][1] if negated else e[1])
            shared = [v for v in s.kinds if v in inner.kinds]
            if not shared:
                there = not inner.df.isEmpty()
                return s if there != negated else Sols(s.df.limit(0), s.kinds, s.loose)
            right = inner.df.select(*[own(v).alias(f"_r_{v}") for v in shared])
            cond = reduce(lambda x, y: x & y, [own(v) == own(f"_r_{v}") for v in shared])
            return Sols(s.df.join(right, cond, "left_anti" if negated else "left_semi"), s.kinds, s.loose)
        return Sols(s.df.where(self.truth(self.value(s, e))), s.kinds, s.loose)

    def optional(self, s: Sols, g: Group) -> Sols:
        """A filter inside an OPTIONAL may use variables from outside: it is then part of the join."""
        inner = self.solve(Group([p for p in g.parts if p[0] != "filter"]))
        tests = [p[1] for p in g.parts if p[0] == "filter"]
        if not tests:
            return self.join(s, inner, "left")
        marked = Sols(s.df.withColumn("_row", F.monotonically_increasing_id()), {**s.kinds, "_row": "int"}, s.loose)
        marked = Sols(cut(marked.df), marked.kinds, marked.loose)
        both = self.join(marked, inner)
        for e in tests:
            both = self.filter(both, e)
        new = [v for v in inner.kinds if v not in s.kinds]
        filled = [v for v in inner.kinds if v in s.loose]
        right = both.df.select("_row", *[own(v) for v in new], *[own(v).alias(f"_r_{v}") for v in filled])
        df = marked.df.join(right, "_row", "left").withColumns({v: F.coalesce(own(v), own(f"_r_{v}")) for v in filled}).drop("_row", *[f"_r_{v}" for v in filled])
        return Sols(df, {**s.kinds, **{v: inner.kinds[v] for v in new}}, s.loose | frozenset(new))

    def minus(self, a: Sols, b: Sols) -> Sols:
        shared = [v for v in a.kinds if v in b.kinds]
        if not shared:
            return a
        right = b.df.select(*[own(v).alias(f"_r_{v}") for v in shared])
        cond = reduce(lambda x, y: x & y, [own(v) == own(f"_r_{v}") for v in shared])
        return Sols(a.df.join(right, cond, "left_anti"), a.kinds, a.loose)

    def union(self, parts: list[Sols]) -> Sols:
        names = list(dict.fromkeys(v for p in parts for v in p.kinds))
        loose = frozenset(v for v in names if any(v not in p.kinds or v in p.loose for p in parts))
        found = {v: {p.kinds[v] for p in parts if v in p.kinds} for v in names}
        kinds = {v: min(ks) if len(ks) == 1 else "str" for v, ks in found.items()}
        out = []
        for p in parts:
            have = [(own(v) if p.kinds[v] == kinds[v] else self.text(Val(own(v), p.kinds[v]))).alias(v) for v in p.kinds]
            out.append(p.df.select(*have) if have else p.df.select(F.lit(1).alias("_one")))
        return Sols(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), out), kinds, loose)

    def inline(self, names: list[str], rows: list[list]) -> Sols:
        data = [tuple(None if t is None else (t.kind, t.value, t.datatype, t.lang) for t in row) for row in rows]
        df = self.spark.createDataFrame(data, ", ".join(f"`{n}` {rdf.TERM}" for n in names))
        return Sols(df, {n: "term" for n in names}, frozenset(n for k, n in enumerate(names) if any(r[k] is None for r in rows)))

    # select ----------------------------------------------------------------------------------------------

    def select(self, q: Select) -> Sols:
        s = self.solve(q.where)
        if q.values:
            s = self.join(s, self.inline(*q.values))
        items = [(e or ("var", n), n) for e, n in q.items]
        if q.star:
            items = [(("var", v), v) for v in s.kinds if not v.startswith("_")]
        having, order = list(q.having), [e for e, _ in q.order]
        if q.group or any(contains_aggregate(e) for e, _ in items):
            s, items, having, order = self.grouped(s, q, items, having, order)
        for e in having:
            s = self.filter(s, e)
        df, kinds = s.df, dict(s.kinds)
        for e, n in items:
            if e != ("var", n):
                v = self.value(Sols(df, kinds), e)
                df, kinds[n] = df.withColumn(n, v.c), v.kind
            elif n not in kinds:
                df, kinds[n] = df.withColumn(n, F.lit(None).cast("string")), "str"
        keys = []
        for k, e in enumerate(order):
            v = self.value(Sols(df, kinds), e)
            for c in (self.num(v), self.text(v)):
                name = f"_o{len(keys)}"
                keys.append((name, c, q.order[k][1]))
        df = df.select(*[own(n) for _, n in items], *[c.alias(n) for n, c, _ in keys])
        if q.distinct:
            df = df.dropDuplicates([n for _, n in items])
        if keys:
            df = df.orderBy(*[F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_last() for n, _, down in keys])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Sols(df.drop(*[n for n, _, _ in keys]), {n: kinds[n] for _, n in items}, s.loose | frozenset(n for _, n in items))

    def grouped(self, s: Sols, q: Select, items, having, order):
        slots: dict = {}
        keys, kinds = [], {}
        for e, name in q.group:
            v = self.value(s, e)
            keys.append(v.c.alias(name))
            kinds[name] = v.kind

        def pulled(e):
            if isinstance(e, tuple) and e and e[0] == "agg":
                mark = repr(e)
                if mark not in slots:
                    slots[mark] = (f"_agg{len(slots)}", *self.aggregate(s, e))
                name, _, kind = slots[mark]
                return ("slot", name, kind)
            if isinstance(e, tuple):
                return tuple(pulled(x) for x in e)
            return [pulled(x) for x in e] if isinstance(e, list) else e

        items, having, order = [(pulled(e), n) for e, n in items], [pulled(e) for e in having], [pulled(e) for e in order]
        aggs = [c.alias(n) for n, c, _ in slots.values()] or [F.count(F.lit(1)).alias("_n")]
        df = s.df.groupBy(*keys).agg(*aggs)
        return Sols(df, {**kinds, **{n: k for n, _, k in slots.values()}}), items, having, order

    def aggregate(self, s: Sols, e) -> tuple[Column, str]:
        _, name, distinct, arg, sep = e
        if arg is None:
            return F.count(F.lit(1)), "int"
        v = self.value(s, arg)
        if name == "COUNT":
            return (F.count_distinct(v.c) if distinct else F.count(v.c)), "int"
        number, text = self.num(v), self.text(v)
        if name == "SUM":
            return F.coalesce(F.sum_distinct(number) if distinct else F.sum(number), F.lit(0.0)), "num"
        if name == "AVG":
            return (F.try_divide(F.sum_distinct(number), F.count_distinct(number)) if distinct else F.avg(number)), "num"
        if name in ("MIN", "MAX"):
            # numbers before texts: the smallest number, or the smallest text where there is no number
            pick = F.min if name == "MIN" else F.max
            shown = F.min_by(text, number) if name == "MIN" else F.max_by(text, number)
            return F.coalesce(F.when(pick(number).isNotNull(), shown), pick(text)), "str"
        if name == "SAMPLE":
            return F.min(text), "str"
        values = F.collect_set(text) if distinct else F.collect_list(text)
        return F.array_join(F.array_sort(values), sep), "str"

    def shown(self, s: Sols) -> DataFrame:
        """Terms as their text; numbers, booleans and strings as they are."""
        return s.df.select(*[(own(n)["value"] if k == "term" else own(n)).alias(n) for n, k in s.kinds.items() if not n.startswith("_")])


def contains_aggregate(e) -> bool:
    return isinstance(e, (tuple, list)) and (bool(e) and e[0] == "agg" or any(contains_aggregate(x) for x in e))


def closure(pairs: DataFrame) -> DataFrame:
    """Transitive closure by doubling: each round joins the paths found so far with themselves."""
    known = cut(pairs.distinct())
    n = known.count()
    while True:
        more = known.select(F.col("s"), F.col("o").alias("m")).join(known.select(F.col("s").alias("m"), "o"), "m").select("s", "o")
        known = cut(known.unionAll(more).distinct())
        size = known.count()
        if size == n:
            return known
        n = size


# -- statements ---------------------------------------------------------------------------------------------------


def template(engine: Engine, s: Sols, patterns: list) -> DataFrame:
    """Triples from a template; a pattern with an unbound variable gives none."""
    out = []
    for a, p, b in patterns:
        def col_of(x):
            if isinstance(x, V):
                if x.name not in s.kinds:
                    return F.lit(None).cast(rdf.TERM)
                k = s.kinds[x.name]
                return own(x.name) if k == "term" else rdf.term("lit", own(x.name), {"num": XSD + "double", "int": XSD + "integer", "bool": XSD + "boolean"}.get(k, "")).cast(rdf.TERM)
            if isinstance(x, PathExpr):
                return T("iri", x.args[0]).column()
            return x.column()

        g = engine.graph.value if isinstance(engine.graph, T) else ""
        rows = s.df.select(col_of(a).alias("s"), col_of(p)["value"].alias("p"), col_of(b).alias("o"), F.lit(g).alias("g"))
        out.append(rows.where("s is not null and p is not null and o is not null and s.value is not null and o.value is not null"))
    return reduce(DataFrame.unionAll, out)


def quads(p: Parser) -> list[tuple]:
    """``{ triples GRAPH g { triples } }`` as (graph or None, patterns)."""
    c, out, plain = p.c, [], []
    c.need("{")
    while not c.sym("}"):
        if c.sym("."):
            continue
        if c.word("GRAPH"):
            name, inner = T("iri", p.iri()), []
            c.need("{")
            while not c.sym("}"):
                if not c.sym("."):
                    p.triples(inner)
            out.append((name, inner))
        else:
            p.triples(plain)
    return [(None, plain), *out] if plain else out


def execute(spark: SparkSession, store: TripleStore, text: str, params: dict | None = None) -> tuple[TripleStore, DataFrame]:
    """The store after the request, and the rows of its last query."""
    for name, v in (params or {}).items():
        text = re.sub(rf"\$\b{name}\b", (lambda m, v=v: '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"') if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v), text)
    p = Parser(text)
    out = spark.createDataFrame([], "s string")
    while True:
        p.prologue()
        if p.c.end():
            return store, out
        store, rows = statement(spark, store, p)
        out = rows if rows is not None else out
        p.c.sym(";")


def statement(spark: SparkSession, store: TripleStore, p: Parser) -> tuple[TripleStore, DataFrame | None]:
    c, engine = p.c, Engine(spark, store)
    if c.is_word("SELECT"):
        return store, engine.shown(engine.select(p.select()))
    if c.word("ASK"):
        c.word("WHERE")
        s = engine.solve(p.group())
        return store, s.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))
    if c.word("CONSTRUCT"):
        if c.is_sym("{"):
            patterns = [t for _, ts in quads(p) for t in ts]
            c.need_word("WHERE")
            q = Select(star=True, where=p.group())
        else:
            c.need_word("WHERE")
            at = c.at
            patterns = [t for _, ts in quads(p) for t in ts]
            c.at = at
            q = Select(star=True, where=p.group())
        p.modifiers(q)
        made = template(engine, engine.select(q), patterns).distinct()
        return store, made.select(F.col("s.value").alias("subject"), F.col("p").alias("predicate"), F.col("o.value").alias("object"))
    if c.word("DESCRIBE"):
        names, given = [], []
        while c.now.kind in ("param", "iri", "pname"):
            names.append(V(c.step().text[1:])) if c.now.kind == "param" else given.append(T("iri", p.iri()))
        wanted = []
        if names:
            c.word("WHERE")
            s = engine.solve(p.group())
            wanted = [s.df.select(own(v.name).alias("_s")) for v in names if v.name in s.kinds]
        wanted += [spark.range(1).select(t.column().alias("_s")) for t in given]
        subjects = reduce(DataFrame.unionAll, wanted).distinct()
        rows = store.of(None).join(subjects, F.col("s") == F.col("_s"), "left_semi")
        return store, rows.select(F.col("s.value").alias("subject"), F.col("p").alias("predicate"), F.col("o.value").alias("object"))
    return update(spark, store, p), None


def update(spark: SparkSession, store: TripleStore, p: Parser) -> TripleStore:
    c = p.c
    unit = Engine(spark, store).unit()

    def rows(groups, s: Sols) -> DataFrame:
        return reduce(DataFrame.unionAll, [template(Engine(spark, store, g), s, ts) for g, ts in groups])

    if c.word("INSERT", "DATA"):
        return store.insert(rows(quads(p), unit))
    if c.word("DELETE", "DATA"):
        return store.delete(rows(quads(p), unit))
    if c.word("DELETE", "WHERE"):
        groups = quads(p)
        s = _solved(Engine(spark, store), Group([("graph", g, Group([("bgp", ts)])) if g else ("bgp", ts) for g, ts in groups]))
        return store.delete(rows(groups, s))
    if c.is_word("DELETE", "INSERT", "WITH"):
        graph = T("iri", p.iri()) if c.word("WITH") else None
        gone = quads(p) if c.word("DELETE") else []
        new = quads(p) if c.word("INSERT") else []
        c.need_word("WHERE")
        # bindings once, then all deletions, then all insertions
        s = _solved(Engine(spark, store, graph), p.group())
        if gone:
            store = store.delete(rows([(g or graph, ts) for g, ts in gone], s))
        return store.insert(rows([(g or graph, ts) for g, ts in new], s)) if new else store
    if c.is_word("CLEAR", "DROP"):
        c.step()
        c.word("SILENT")
        if c.word("ALL"):
            return TripleStore.empty(spark)
        if c.word("NAMED"):
            return TripleStore(spark, store.df.where("g = ''"), frozenset())
        if c.word("DEFAULT"):
            return TripleStore(spark, store.df.where("g <> ''"), store.graphs)
        c.word("GRAPH")
        name = p.iri()
        return TripleStore(spark, store.df.where(F.col("g") != name), store.graphs - {name})
    if c.word("CREATE"):
        c.word("SILENT")
        c.need_word("GRAPH")
        return TripleStore(spark, store.df, store.graphs | {p.iri()})
    if c.word("LOAD"):
        c.word("SILENT")
        path = p.iri()
        graph = ""
        if c.word("INTO"):
            c.need_word("GRAPH")
            graph = p.iri()
        return store.insert(rdf.read_ntriples(spark, path, graph))
    for verb in ("COPY", "MOVE", "ADD"):
        if c.word(verb):
            c.word("SILENT")
            ends = []
            for _ in range(2):
                c.word("TO")
                if c.word("DEFAULT"):
                    ends.append("")
                else:
                    c.word("GRAPH")
                    ends.append(p.iri())
            source, target = ends
            moved = store.df.where(F.col("g") == source).withColumn("g", F.lit(target))
            rest = store.df
            if verb != "ADD" and source != target:
                rest = rest.where(F.col("g") != target)
            if verb == "MOVE" and source != target:
                rest = rest.where(F.col("g") != source)
            return TripleStore(spark, rest, store.graphs).insert(moved)
    c.fail("expected a query or an update")


def _solved(engine: Engine, g: Group) -> Sols:
    s = engine.solve(g)
    return Sols(cut(s.df), s.kinds, s.loose)
