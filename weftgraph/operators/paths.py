"""Variable-length and shortest paths over an edge table ``_from, _to``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Beyond this many joins in one plan a level is checkpointed, so that plans stay small.
UNROLL = 5


def variable_length(rows: DataFrame, start: str, steps: DataFrame, low: int, high: int, trail: bool = True) -> DataFrame:
    """One row per path of ``low`` to ``high`` edges from column ``start``: with ``_to``, ``_length``, ``_edges``.

    Paths repeat no edge unless ``trail`` is off. Length 0 ends at the start itself. Up to ``UNROLL`` levels are
    unrolled joins in one plan; further ones are checkpointed, and end as soon as nothing is left to extend.
    """
    at = rows.withColumn("_to", F.col(f"`{start}`")).withColumn("_length", F.lit(0).cast("bigint")).withColumn("_edges", F.array().cast("array<bigint>"))
    levels = [at] if low == 0 else []
    hop = steps.select(F.col("_from").alias("_hop_from"), F.col("_to").alias("_hop_to"), "_edge")
    for n in range(1, high + 1):
        at = at.join(hop, F.col("_to") == F.col("_hop_from"))
        if trail and n > 1:
            at = at.where(~F.array_contains("_edges", F.col("_edge")))
        at = at.withColumn("_to", F.col("_hop_to")).withColumn("_length", F.lit(n).cast("bigint")).withColumn("_edges", F.array_append("_edges", F.col("_edge"))).drop("_hop_from", "_hop_to", "_edge")
        if n > UNROLL:
            at = cut(at)
            if at.isEmpty():
                break
        if n >= low:
            levels.append(at)
    return reduce(DataFrame.unionAll, levels) if levels else at.limit(0)


def shortest_paths(pairs: DataFrame, steps: DataFrame, most: int | None = None) -> DataFrame:
    """``_a, _b, _length, _paths`` for the pairs ``_a, _b`` that a path joins: its length and how many there are.

    One breadth-first search from every different node of the side that has fewer, along the edges or against
    them: a source is searched once however many nodes it is paired with. The frontier holds the number of
    shortest paths to each node; a source leaves the search when it has reached all of its partners.
    """
    pairs = cut(pairs)
    n_a, n_b = pairs.agg(F.count_distinct("_a"), F.count_distinct("_b")).first()
    backwards = n_b < n_a
    hop = steps.groupBy(F.col("_to" if backwards else "_from").alias("_here"), F.col("_from" if backwards else "_to").alias("_next")).agg(F.count(F.lit(1)).alias("_ways"))
    left = pairs.select(F.col("_b" if backwards else "_a").alias("_s"), F.col("_a" if backwards else "_b").alias("_t"))
    front = left.select("_s").distinct().select("_s", F.col("_s").alias("_at"), F.lit(1).cast("bigint").alias("_paths"))
    seen, found, n = [front.select("_s", "_at")], [], 0
    limit = most if most is not None else 1 << 30
    while True:
        met = left.join(front.withColumnRenamed("_at", "_t"), ["_s", "_t"]).select("_s", "_t", F.lit(n).cast("bigint").alias("_length"), "_paths")
        found.append(met)
        n += 1
        if n > limit:
            break
        left = cut(left.join(met.select("_s", "_t"), ["_s", "_t"], "left_anti"))
        # a node can be met again at any earlier depth, so all of them are kept, folded now and then
        known = reduce(DataFrame.unionAll, seen)
        if len(seen) > UNROLL:
            known = cut(known)
            seen = [known]
        live = front.join(left.select("_s").distinct(), "_s", "left_semi")
        moved = live.join(hop, F.col("_at") == F.col("_here")).groupBy("_s", F.col("_next").alias("_at")).agg(F.sum(F.col("_paths") * F.col("_ways")).alias("_paths"))
        front = cut(moved.join(known, ["_s", "_at"], "left_anti"))
        if front.isEmpty():
            break
        seen.append(front.select("_s", "_at"))
    out = reduce(DataFrame.unionAll, found)
    return out.select(F.col("_t" if backwards else "_s").alias("_a"), F.col("_s" if backwards else "_t").alias("_b"), "_length", "_paths")
