"""The algebra that all query languages are translated to."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

# -- expressions ------------------------------------------------------------------------------------


class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    of: Expr
    key: str


@dataclass(frozen=True)
class HasLabel(Expr):
    of: Expr
    labels: tuple[str, ...]


@dataclass(frozen=True)
class Op(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapOf(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Index(Expr):
    of: Expr
    at: Expr


@dataclass(frozen=True)
class Slice(Expr):
    of: Expr
    low: Expr | None
    high: Expr | None


@dataclass(frozen=True)
class Comprehension(Expr):
    var: str
    over: Expr
    where: Expr | None
    give: Expr | None


@dataclass(frozen=True)
class Quantified(Expr):
    """any, all, none or single over a list."""

    kind: str
    var: str
    over: Expr
    where: Expr


@dataclass(frozen=True)
class SubQuery(Expr):
    """``exists`` or ``count`` of a pattern."""

    kind: str
    paths: tuple[Path, ...]
    where: Expr | None


# -- patterns ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class NodePat:
    var: str
    labels: tuple[str, ...] = ()
    props: tuple[tuple[str, Expr], ...] = ()
    anonymous: bool = False


@dataclass(frozen=True)
class EdgePat:
    var: str
    types: tuple[str, ...] = ()
    direction: str = "out"  # out, in, both
    props: tuple[tuple[str, Expr], ...] = ()
    low: int | None = None  # a variable length where either is set
    high: int | None = None
    variable: bool = False
    anonymous: bool = False


@dataclass(frozen=True)
class Path:
    nodes: tuple[NodePat, ...]
    edges: tuple[EdgePat, ...]
    name: str | None = None
    shortest: str | None = None  # "one" or "all"


# -- operators -----------------------------------------------------------------------------------------


class Operator:
    pass


@dataclass(frozen=True)
class Start(Operator):
    """One row without columns."""


@dataclass(frozen=True)
class Match(Operator):
    input: Operator
    paths: tuple[Path, ...]
    where: Expr | None = None
    optional: bool = False


@dataclass(frozen=True)
class Filter(Operator):
    input: Operator
    where: Expr


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str


@dataclass(frozen=True)
class SortKey:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Project(Operator):
    """WITH or RETURN: items, implicit grouping, HAVING or WHERE, ORDER BY, SKIP and LIMIT."""

    input: Operator
    items: tuple[Item, ...]
    distinct: bool = False
    star: bool = False
    having: Expr | None = None
    order: tuple[SortKey, ...] = ()
    skip: Expr | None = None
    limit: Expr | None = None
    final: bool = False


@dataclass(frozen=True)
class Unwind(Operator):
    input: Operator
    expr: Expr
    var: str


@dataclass(frozen=True)
class Union(Operator):
    parts: tuple[Operator, ...]
    all: bool = True


@dataclass(frozen=True)
class Create(Operator):
    input: Operator
    paths: tuple[Path, ...]


@dataclass(frozen=True)
class Merge(Operator):
    input: Operator
    path: Path
    on_create: tuple = ()
    on_match: tuple = ()


@dataclass(frozen=True)
class SetItems(Operator):
    """(variable, key or None for a whole map, expression, "replace" or "merge")."""

    input: Operator
    items: tuple


@dataclass(frozen=True)
class SetLabels(Operator):
    input: Operator
    var: str
    labels: tuple[str, ...]
    remove: bool = False


@dataclass(frozen=True)
class Delete(Operator):
    input: Operator
    vars: tuple[str, ...]
    detach: bool = False


WRITES = (Create, Merge, SetItems, SetLabels, Delete)

# -- walking ---------------------------------------------------------------------------------------------


def children(x: Any):
    if is_dataclass(x):
        for f in fields(x):
            yield getattr(x, f.name)
    elif isinstance(x, (tuple, list)):
        yield from x


def walk(x: Any):
    yield x
    for y in children(x):
        yield from walk(y)


AGGREGATES = {"count", "sum", "avg", "mean", "min", "max", "collect", "stdev", "stddev", "stdevp", "stddevp", "percentiledisc", "percentile_disc", "percentilecont", "percentile_cont"}


def has_aggregate(e: Any) -> bool:
    if isinstance(e, Call) and e.name.lower() in AGGREGATES:
        return True
    return not isinstance(e, SubQuery) and any(has_aggregate(c) for c in children(e))


def name_of(e: Expr) -> str:
    """Column name of an item without an alias."""
    if isinstance(e, Var):
        return e.name
    if isinstance(e, Prop) and isinstance(e.of, Var):
        return f"{e.of.name}.{e.key}"
    if isinstance(e, Call):
        return f"{e.name}(...)"
    if isinstance(e, Lit):
        return str(e.value)
    return "expr"
