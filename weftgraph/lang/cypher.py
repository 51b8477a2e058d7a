"""Cypher and GQL: one recursive-descent parser, since their clauses and patterns are the same in kind.

GQL adds INSERT, HAVING and FILTER, and takes clauses in any order too.
"""

from __future__ import annotations

import re

from ..plans import ir
from .lexing import Cursor, tokens

_TOKENS = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|--[^\n>\[\-<(][^\n]*|/\*.*?\*/)
    |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+)
    |(?P<int>\d+)
    |(?P<quoted>`[^`]+`)
    |(?P<param>\$\w+)
    |(?P<name>[^\W\d]\w*)
    |(?P<symbol><>|!=|<=|>=|=~|\.\.|\|\||\+=|[-<>=+*/%^.,:;|(){}\[\]!&])""",
    re.X | re.S,
)

_CLAUSES = ("MATCH", "OPTIONAL", "WHERE", "WITH", "RETURN", "UNWIND", "ORDER", "SKIP", "OFFSET", "LIMIT", "CREATE", "INSERT", "MERGE", "DELETE", "DETACH", "NODETACH", "SET", "REMOVE", "HAVING", "UNION", "FILTER", "ON", "FOR")


class Parser:
    def __init__(self, text: str, gql: bool = False):
        self.c: Cursor = tokens(text, _TOKENS)
        self.gql, self.fresh = gql, 0

    def anonymous(self) -> str:
        self.fresh += 1
        return f"_a{self.fresh}"

    # -- statements -----------------------------------------------------------------------------------

    def parse(self) -> ir.Operator:
        parts, every = [self.single()], True
        while self.c.word("UNION"):
            every = self.c.word("ALL")
            parts.append(self.single())
        self.c.sym(";")
        if not self.c.end():
            self.c.fail("unexpected input")
        return parts[0] if len(parts) == 1 else ir.Union(tuple(parts), every)

    def single(self) -> ir.Operator:
        c, op, seen = self.c, ir.Start(), False
        while not c.end() and not c.is_sym(";") and not c.is_word("UNION"):
            seen = True
            if c.word("OPTIONAL"):
                c.need_word("MATCH")
                op = self.match(op, True)
            elif c.word("MATCH"):
                op = self.match(op, False)
            elif c.word("UNWIND"):
                e = self.expr()
                c.need_word("AS")
                op = ir.Unwind(op, e, c.name())
            elif c.word("FOR"):
                var = c.name()
                c.need_word("IN")
                op = ir.Unwind(op, self.expr(), var)
            elif c.word("FILTER"):
                c.word("WHERE")
                op = ir.Filter(op, self.expr())
            elif c.word("WHERE"):
                op = ir.Filter(op, self.expr())
            elif c.is_word("WITH", "RETURN"):
                op = self.project(op)
            elif c.word("CREATE") or c.word("INSERT"):
                op = ir.Create(op, tuple(self.patterns()))
            elif c.word("MERGE"):
                op = self.merge(op)
            elif c.word("SET"):
                op = self.set_clause(op)
            elif c.word("REMOVE"):
                op = self.remove(op)
            elif c.is_word("DETACH", "DELETE", "NODETACH"):
                detach = c.word("DETACH")
                c.word("NODETACH")
                c.need_word("DELETE")
                names = [c.name()]
                while c.sym(","):
                    names.append(c.name())
                op = ir.Delete(op, tuple(names), detach)
            else:
                c.fail("expected a clause")
        if not seen:
            c.fail("empty query")
        return op

    def match(self, op: ir.Operator, optional: bool) -> ir.Operator:
        paths = tuple(self.patterns())
        where = self.expr() if self.c.word("WHERE") else None
        return ir.Match(op, paths, where, optional)

    def project(self, op: ir.Operator) -> ir.Operator:
        c = self.c
        final = c.step().text.upper() == "RETURN"
        distinct, star, items = c.word("DISTINCT"), False, []
        if c.sym("*"):
            star = True
            if c.sym(","):
                items = self.items()
        else:
            items = self.items()
        having, order, skip, limit = None, [], None, None
        while True:
            if c.word("HAVING"):
                having = self.expr()
            elif not final and c.is_word("WHERE") and c.word("WHERE"):
                having = self.expr()
            elif c.word("ORDER", "BY"):
                while True:
                    e = self.expr()
                    down = c.word("DESC") or c.word("DESCENDING")
                    if not down:
                        c.word("ASC") or c.word("ASCENDING")
                    order.append(ir.SortKey(e, down))
                    if not c.sym(","):
                        break
            elif c.word("SKIP") or c.word("OFFSET"):
                skip = self.expr()
            elif c.word("LIMIT"):
                limit = self.expr()
            elif final and c.word("GROUP", "BY"):
                self.items()  # grouping is implied by the items
            else:
                break
        return ir.Project(op, tuple(items), distinct, star, having, tuple(order), skip, limit, final)

    def items(self) -> list[ir.Item]:
        out = []
        while True:
            e = self.expr()
            out.append(ir.Item(e, self.c.name() if self.c.word("AS") else ir.name_of(e)))
            if not self.c.sym(","):
                return out

    def merge(self, op: ir.Operator) -> ir.Operator:
        path, made, met = self.pattern(), [], []
        while self.c.word("ON"):
            target = made if self.c.word("CREATE") else met
            if target is met:
                self.c.need_word("MATCH")
            self.c.need_word("SET")
            target += self.assignments()
        return ir.Merge(op, path, tuple(made), tuple(met))

    def assignments(self) -> list[tuple]:
        out = []
        while True:
            var = self.c.name()
            if self.c.is_sym(":"):
                out.append((var, "@labels", tuple(self.labels()), "merge"))
            elif self.c.sym("."):
                key = self.c.name()
                self.c.need("=")
                out.append((var, key, self.expr(), "merge"))
            elif self.c.sym("+="):
                out.append((var, None, self.expr(), "merge"))
            else:
                self.c.need("=")
                out.append((var, None, self.expr(), "replace"))
            if not self.c.sym(","):
                return out

    def set_clause(self, op: ir.Operator) -> ir.Operator:
        items = self.assignments()
        values = tuple(i for i in items if i[1] != "@labels")
        if values:
            op = ir.SetItems(op, values)
        for var, key, labels, _ in items:
            if key == "@labels":
                op = ir.SetLabels(op, var, labels)
        return op

    def remove(self, op: ir.Operator) -> ir.Operator:
        while True:
            var = self.c.name()
            if self.c.sym("."):
                op = ir.SetItems(op, ((var, self.c.name(), ir.Lit(None), "merge"),))
            else:
                op = ir.SetLabels(op, var, tuple(self.labels()), True)
            if not self.c.sym(","):
                return op

    # -- patterns -----------------------------------------------------------------------------------------

    def patterns(self) -> list[ir.Path]:
        out = [self.pattern()]
        while self.c.sym(","):
            out.append(self.pattern())
        return out

    def pattern(self) -> ir.Path:
        c, name = self.c, None
        if c.now.kind in ("name", "quoted") and c.ahead().text == "=" and c.ahead().kind == "symbol":
            name = c.name()
            c.need("=")
        if c.is_word("SHORTESTPATH", "ALLSHORTESTPATHS") and c.ahead().text == "(":
            kind = "one" if c.step().text.upper() == "SHORTESTPATH" else "all"
            c.need("(")
            path = self.chain(name)
            c.need(")")
            return ir.Path(path.nodes, path.edges, name, kind)
        return self.chain(name)

    def chain(self, name: str | None) -> ir.Path:
        nodes, edges = [self.node()], []
        while self.c.is_sym("-", "<"):
            edges.append(self.edge())
            nodes.append(self.node())
        return ir.Path(tuple(nodes), tuple(edges), name)

    def labels(self) -> list[str]:
        out = []
        while self.c.sym(":") or (out and self.c.sym("&")):
            out.append(self.c.name())
        return out

    def node(self) -> ir.NodePat:
        c = self.c
        c.need("(")
        named = c.now.kind in ("name", "quoted")
        var = c.name() if named else self.anonymous()
        labels = self.labels()
        props = self.map_items() if c.is_sym("{") else []
        c.need(")")
        return ir.NodePat(var, tuple(labels), tuple(props), not named)

    def edge(self) -> ir.EdgePat:
        c, left = self.c, self.c.sym("<")
        c.need("-")
        var, types, props, low, high, variable, named = self.anonymous(), [], [], None, None, False, False
        if c.sym("["):
            if c.now.kind in ("name", "quoted"):
                var, named = c.name(), True
            if c.sym(":"):
                types.append(c.name())
                while c.sym("|"):
                    c.sym(":")
                    types.append(c.name())
            if c.sym("*"):
                variable = True
                if c.now.kind == "int":
                    low = int(c.step().text)
                    high = low
                    if c.sym(".."):
                        high = int(c.step().text) if c.now.kind == "int" else None
                elif c.sym(".."):
                    low = 1
                    high = int(c.step().text) if c.now.kind == "int" else None
            if c.is_sym("{"):
                if c.ahead().kind == "int" and c.ahead(2).text in (",", "}"):
                    low, high, variable = *self.bounds(), True
                else:
                    props = self.map_items()
            c.need("]")
        c.need("-")
        right = c.sym(">")
        if c.is_sym("{"):
            low, high, variable = *self.bounds(), True
        direction = "both" if left == right else "in" if left else "out"
        return ir.EdgePat(var, tuple(types), direction, tuple(props), low, high, variable, not named)

    def bounds(self) -> tuple[int, int | None]:
        self.c.need("{")
        low = int(self.c.step().text)
        high: int | None = low
        if self.c.sym(","):
            high = int(self.c.step().text) if self.c.now.kind == "int" else None
        self.c.need("}")
        return low, high

    def map_items(self) -> list[tuple[str, ir.Expr]]:
        self.c.need("{")
        out = []
        while not self.c.sym("}"):
            key = self.c.step().text
            self.c.need(":")
            out.append((key, self.expr()))
            if not self.c.sym(","):
                self.c.need("}")
                break
        return out

    # -- expressions ------------------------------------------------------------------------------------------

    def expr(self) -> ir.Expr:
        return self.binary(0)

    _LEVELS = (("OR",), ("XOR",), ("AND",))

    def binary(self, level: int) -> ir.Expr:
        if level == len(self._LEVELS):
            return self.negation()
        e = self.binary(level + 1)
        while self.c.is_word(*self._LEVELS[level]):
            name = self.c.step().text.lower()
            e = ir.Op(name, (e, self.binary(level + 1)))
        return e

    def negation(self) -> ir.Expr:
        if self.c.word("NOT"):
            return ir.Op("not", (self.negation(),))
        return self.comparison()

    def comparison(self) -> ir.Expr:
        c, e = self.c, self.sum()
        while True:
            if c.is_sym("=", "<>", "!=", "<", "<=", ">", ">=", "=~"):
                name = c.step().text
                right = self.sum()
                test = ir.Op({"!=": "<>"}.get(name, name), (e, right))
                # a < b < c means both
                if c.is_sym("<", "<=", ">", ">="):
                    name = c.step().text
                    test = ir.Op("and", (test, ir.Op(name, (right, self.sum()))))
                e = test
            elif c.word("IN"):
                e = ir.Op("in", (e, self.sum()))
            elif c.word("NOT", "IN"):
                e = ir.Op("not", (ir.Op("in", (e, self.sum())),))
            elif c.word("STARTS", "WITH"):
                e = ir.Op("starts", (e, self.sum()))
            elif c.word("ENDS", "WITH"):
                e = ir.Op("ends", (e, self.sum()))
            elif c.word("CONTAINS"):
                e = ir.Op("contains", (e, self.sum()))
            elif c.word("LIKE"):
                e = ir.Op("like", (e, self.sum()))
            elif c.word("IS", "NOT", "NULL"):
                e = ir.Op("notnull", (e,))
            elif c.word("IS", "NULL"):
                e = ir.Op("null", (e,))
            else:
                return e

    def sum(self) -> ir.Expr:
        e = self.product()
        while self.c.is_sym("+", "-", "||"):
            name = self.c.step().text
            e = ir.Op(name, (e, self.product()))
        return e

    def product(self) -> ir.Expr:
        e = self.power()
        while self.c.is_sym("*", "/", "%"):
            name = self.c.step().text
            e = ir.Op(name, (e, self.power()))
        return e

    def power(self) -> ir.Expr:
        e = self.unary()
        return ir.Op("^", (e, self.power())) if self.c.sym("^") else e

    def unary(self) -> ir.Expr:
        if self.c.sym("-"):
            e = self.unary()
            return ir.Lit(-e.value) if isinstance(e, ir.Lit) and not isinstance(e.value, str) else ir.Op("neg", (e,))
        if self.c.sym("+"):
            return self.unary()
        return self.postfix()

    def postfix(self) -> ir.Expr:
        c, e = self.c, self.atom()
        while True:
            if c.is_sym(".") and c.ahead().kind in ("name", "quoted"):
                c.step()
                e = ir.Prop(e, c.name())
            elif c.is_sym("["):
                c.step()
                low = None if c.is_sym("..") else self.expr()
                if c.sym(".."):
                    e = ir.Slice(e, low, None if c.is_sym("]") else self.expr())
                else:
                    e = ir.Index(e, low)
                c.need("]")
            elif c.is_sym(":") and isinstance(e, ir.Var):
                e = ir.HasLabel(e, tuple(self.labels()))
            else:
                return e

    def atom(self) -> ir.Expr:
        c, t = self.c, self.c.now
        if t.kind == "string":
            return ir.Lit(c.step().text)
        if t.kind == "int":
            return ir.Lit(int(c.step().text))
        if t.kind == "float":
            return ir.Lit(float(c.step().text))
        if t.kind == "param":
            return ir.Param(c.step().text[1:])
        if c.sym("("):
            e = self.expr()
            c.need(")")
            return e
        if c.is_sym("["):
            return self.list_or_comprehension()
        if c.is_sym("{"):
            return ir.MapOf(tuple(self.map_items()))
        if t.kind == "quoted":
            return ir.Var(c.name())
        if t.kind != "name":
            c.fail("expected an expression")
        upper = t.text.upper()
        if upper in ("TRUE", "FALSE", "NULL") and c.ahead().text != "(":
            c.step()
            return ir.Lit({"TRUE": True, "FALSE": False, "NULL": None}[upper])
        if upper == "CASE":
            return self.case()
        if upper in ("EXISTS", "COUNT") and c.ahead().text == "{":
            return self.subquery(upper.lower())
        if upper in ("ANY", "ALL", "NONE", "SINGLE") and c.ahead().text == "(" and c.ahead(3).text.upper() == "IN":
            c.step()
            c.need("(")
            var = c.name()
            c.need_word("IN")
            over = self.expr()
            c.need_word("WHERE")
            e = ir.Quantified(upper.lower(), var, over, self.expr())
            c.need(")")
            return e
        if c.ahead().text == "(" and c.ahead().kind == "symbol":
            return self.call()
        return ir.Var(c.name())

    def call(self) -> ir.Expr:
        c, name = self.c, self.c.name()
        c.need("(")
        if c.sym("*"):
            c.need(")")
            return ir.Call(name, (), star=True)
        distinct, args = c.word("DISTINCT"), []
        if name.lower() == "exists" and c.is_sym("("):
            path = self.chain(None)
            c.need(")")
            return ir.SubQuery("exists", (path,), None)
        while not c.is_sym(")"):
            args.append(self.expr())
            if not c.sym(","):
                break
        c.need(")")
        return ir.Call(name, tuple(args), distinct)

    def case(self) -> ir.Expr:
        c = self.c
        c.need_word("CASE")
        subject = None if c.is_word("WHEN") else self.expr()
        whens = []
        while c.word("WHEN"):
            test = self.expr()
            c.need_word("THEN")
            whens.append((test, self.expr()))
        other = self.expr() if c.word("ELSE") else None
        c.need_word("END")
        return ir.Case(subject, tuple(whens), other)

    def subquery(self, kind: str) -> ir.Expr:
        c = self.c
        c.step()
        c.need("{")
        c.word("MATCH")
        paths = tuple(self.patterns())
        where = self.expr() if c.word("WHERE") else None
        if c.word("RETURN"):
            self.items()
        c.need("}")
        return ir.SubQuery(kind, paths, where)

    def list_or_comprehension(self) -> ir.Expr:
        c = self.c
        c.need("[")
        if c.now.kind in ("name", "quoted") and c.ahead().kind == "name" and c.ahead().text.upper() == "IN":
            var = c.name()
            c.need_word("IN")
            over = self.expr()
            where = self.expr() if c.word("WHERE") else None
            give = self.expr() if c.sym("|") else None
            c.need("]")
            return ir.Comprehension(var, over, where, give)
        items = []
        while not c.is_sym("]"):
            items.append(self.expr())
            if not c.sym(","):
                break
        c.need("]")
        return ir.ListOf(tuple(items))


def parse(text: str, gql: bool = False) -> ir.Operator:
    return Parser(text, gql).parse()
