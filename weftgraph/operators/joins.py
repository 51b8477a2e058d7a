"""Joins of the algebra over frames that are results of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import QueryError

#: Kind of join -> Spark's name for it.
KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}


def combine(left: DataFrame, right: DataFrame, on: list[str], kind: str = "inner") -> DataFrame:
    """Rows of two results that agree on the columns ``on``; null keys meet nothing.

    The key columns come first and once, from whichever side has the row; then the other columns of both sides,
    null where a side has no row. Semi and anti joins keep the left side's columns alone; a cross join takes no keys.
    Other columns must differ in name.
    """
    if kind not in KINDS:
        raise QueryError(f"unknown join {kind}")
    if (kind == "cross") != (not on):
        raise QueryError("a cross join has no keys; every other join has some")
    clash = (set(left.columns) & set(right.columns)) - set(on)
    if clash and kind not in ("semi", "anti"):
        raise QueryError(f"columns in both sides: {', '.join(sorted(clash))}")
    if kind == "cross":
        return left.crossJoin(right)
    a, b = left.alias("a"), right.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.`{c}`") == F.col(f"b.`{c}`") for c in on])
    joined = a.join(b, same, KINDS[kind])
    if kind in ("semi", "anti"):
        return joined.select("a.*")
    keys = [F.coalesce(F.col(f"a.`{c}`"), F.col(f"b.`{c}`")).alias(c) for c in on]
    rest = [F.col(f"{side}.`{c}`") for side, df in (("a", left), ("b", right)) for c in df.columns if c not in on]
    return joined.select(*keys, *rest)
