"""Aggregate functions. All but ``count(*)`` skip nulls; an empty sum is 0. ``sample`` is the smallest value;
``first`` and ``last`` follow the order of rows, which only a sort just before fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .scalar import QueryError


def percentile_disc(df: DataFrame, keys: list[Column], x: Column, p: float) -> DataFrame:
    """The value at place floor(p (n-1)) of each group's sorted values, as column ``_value`` beside the keys ``_k0, _k1, ...``.

    Equal values are counted first; then a running count finds the place. Nothing is collected: a group is a
    sort that can spill.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    counts = df.select(*named, x.cast("double").alias("_value")).where("_value is not null").groupBy(*names, "_value").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    upto, total = F.sum("_n").over(own.orderBy("_value")), F.sum("_n").over(own)
    place = F.floor(F.lit(min(1.0, max(0.0, p))) * (F.col("_total") - 1))
    return counts.select("*", upto.alias("_upto"), total.alias("_total")).where((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place)).select(*names, "_value")


def aggregate(name: str, x: Column | None, kind, distinct: bool, extra: list) -> Column:
    """``x`` is None for ``count(*)``; ``extra`` holds literal arguments after the first."""
    name = name.lower().replace("_", "")
    if name == "count":
        return F.count(F.lit(1)) if x is None else F.count_distinct(x) if distinct else F.count(x)
    if x is None:
        raise QueryError(f"{name}(*) is not an aggregate")
    if name == "sum":
        zero = F.lit(0).cast("bigint") if isinstance(kind, IntegralType) else F.lit(0.0)
        return F.coalesce(F.sum_distinct(x) if distinct else F.sum(x), zero)
    if name in ("avg", "mean"):
        return F.try_divide(F.sum_distinct(x), F.count_distinct(x)) if distinct else F.avg(x)
    if name == "collect":
        return F.collect_set(x) if distinct else F.collect_list(x)
    if name == "percentilecont":
        return F.percentile(x.cast("double"), min(1.0, max(0.0, float(extra[0]) if extra else 0.5)))
    if name == "groupconcat":
        values = F.collect_set(x.cast("string")) if distinct else F.collect_list(x.cast("string"))
        return F.array_join(F.array_sort(values), str(extra[0]) if extra else " ")
    plain = {"min": F.min, "max": F.max, "stdev": F.stddev_samp, "stddev": F.stddev_samp, "stdevp": F.stddev_pop, "stddevp": F.stddev_pop, "first": F.first, "last": F.last, "sample": F.min}
    if name not in plain:
        raise QueryError(f"unknown aggregate {name}")
    return plain[name](x)
