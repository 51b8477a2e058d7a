"""Scalar functions of the query languages as Spark columns. Names are matched without case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, IntegralType, MapType, StringType

INTS, FLOATS = IntegralType, (DoubleType, FloatType)


class QueryError(ValueError):
    """A query that cannot be parsed or bound."""


def to_boolean(x: Column, kind: DataType) -> Column:
    text = F.lower(x.cast("string"))
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def to_integer(x: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType):
        return F.coalesce(x.try_cast("bigint"), x.try_cast("double").try_cast("bigint"))
    return x.try_cast("bigint")


def length(x: Column, kind: DataType) -> Column:
    return F.size(x).cast("bigint") if isinstance(kind, (ArrayType, MapType)) else F.length(x).cast("bigint")


def tail(x: Column, kind: DataType) -> Column:
    return F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(0)))


#: name -> (least, most arguments, build from columns and the first argument's type)
FUNCTIONS: dict[str, tuple[int, int, Callable]] = {
    "size": (1, 1, lambda a, k: length(a[0], k)),
    "length": (1, 1, lambda a, k: length(a[0], k)),
    "coalesce": (1, 99, lambda a, k: F.coalesce(*a)),
    "exists": (1, 1, lambda a, k: a[0].isNotNull()),
    "tostring": (1, 1, lambda a, k: a[0].cast("string")),
    "tointeger": (1, 1, lambda a, k: to_integer(a[0], k)),
    "toint": (1, 1, lambda a, k: to_integer(a[0], k)),
    "tofloat": (1, 1, lambda a, k: a[0].try_cast("double")),
    "toboolean": (1, 1, lambda a, k: to_boolean(a[0], k)),
    "tobool": (1, 1, lambda a, k: to_boolean(a[0], k)),
    "head": (1, 1, lambda a, k: F.get(a[0], F.lit(0))),
    "last": (1, 1, lambda a, k: F.try_element_at(a[0], F.lit(-1))),
    "tail": (1, 1, lambda a, k: tail(a[0], k)),
    "reverse": (1, 1, lambda a, k: F.reverse(a[0])),
    # beyond the reference's own
    "abs": (1, 1, lambda a, k: F.abs(a[0])),
    "ceil": (1, 1, lambda a, k: F.ceil(a[0]).cast("double")),
    "floor": (1, 1, lambda a, k: F.floor(a[0]).cast("double")),
    "round": (1, 2, lambda a, k: F.round(a[0].cast("double"), *a[1:])),
    "sqrt": (1, 1, lambda a, k: F.sqrt(a[0])),
    "exp": (1, 1, lambda a, k: F.exp(a[0])),
    "log": (1, 1, lambda a, k: F.ln(a[0])),
    "sign": (1, 1, lambda a, k: F.signum(a[0]).cast("bigint")),
    "toupper": (1, 1, lambda a, k: F.upper(a[0])),
    "tolower": (1, 1, lambda a, k: F.lower(a[0])),
    "upper": (1, 1, lambda a, k: F.upper(a[0])),
    "lower": (1, 1, lambda a, k: F.lower(a[0])),
    "trim": (1, 1, lambda a, k: F.trim(a[0])),
    "ltrim": (1, 1, lambda a, k: F.ltrim(a[0])),
    "rtrim": (1, 1, lambda a, k: F.rtrim(a[0])),
    "substring": (2, 3, lambda a, k: F.substr(a[0], a[1] + 1, *a[2:])),
    "left": (2, 2, lambda a, k: F.left(a[0], a[1])),
    "right": (2, 2, lambda a, k: F.right(a[0], a[1])),
    "replace": (3, 3, lambda a, k: F.replace(a[0], a[1], a[2])),
    "split": (2, 2, lambda a, k: F.split(a[0], F.concat(F.lit("\\Q"), a[1], F.lit("\\E")))),
    "range": (2, 3, lambda a, k: F.sequence(*[x.cast("bigint") for x in a])),
    "year": (1, 1, lambda a, k: F.year(a[0]).cast("bigint")),
    "month": (1, 1, lambda a, k: F.month(a[0]).cast("bigint")),
    "day": (1, 1, lambda a, k: F.day(a[0]).cast("bigint")),
    "concat": (1, 99, lambda a, k: F.concat(*a)),
}


def call(name: str, args: list[Column], kind: DataType | None) -> Column:
    found = FUNCTIONS.get(name.lower())
    if found is None:
        raise QueryError(f"unknown function {name}")
    least, most, build = found
    if not least <= len(args) <= most:
        raise QueryError(f"{name} takes {least} to {most} arguments, not {len(args)}")
    return build(args, kind)


def divide(a: Column, b: Column, ka: DataType, kb: DataType) -> Column:
    """Two integers: truncating; else floating. Null where the divisor is zero."""
    if isinstance(ka, INTS) and isinstance(kb, INTS):
        return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0).cast("bigint")))
    return F.try_divide(a.cast("double"), b.cast("double"))


def index(x: Column, i: Column, kind: DataType) -> Column:
    """0-based; negative from the end; null out of range; strings by character; maps by key."""
    if isinstance(kind, MapType):
        return F.try_element_at(x, i)
    if isinstance(kind, StringType):
        at = F.when(i >= 0, i + 1).otherwise(F.length(x) + i + 1)
        return F.when((at >= 1) & (at <= F.length(x)), F.substr(x, at.cast("int"), F.lit(1)))
    at = F.when(i >= 0, i).otherwise(F.size(x) + i)
    return F.get(x, at.cast("int"))


def part(x: Column, low: Column | None, high: Column | None, kind: DataType) -> Column:
    """Half-open slice; ends beyond the list are cut back."""
    size = F.length(x) if isinstance(kind, StringType) else F.size(x)
    a = F.greatest(F.lit(0), low.cast("int") if low is not None else F.lit(0))
    b = F.least(size, high.cast("int") if high is not None else size)
    n = F.greatest(F.lit(0), b - a)
    return F.substr(x, a + 1, n) if isinstance(kind, StringType) else F.slice(x, a + 1, n)
