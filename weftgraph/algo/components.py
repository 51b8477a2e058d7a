"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import local

#: Edges that one task works on; above this the graph is contracted in distributed rounds. About 150 bytes each.
TASK_EDGES = 2_000_000


def in_one_task(edges: DataFrame) -> DataFrame:
    """Components of the edges ``u, v`` of a small graph, worked out on arrays in one task."""
    kind = dict(edges.dtypes)["u"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            table = pa.Table.from_batches(found)
            both = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).combine_chunks().dictionary_encode()
            ids = both.dictionary
            order = pc.sort_indices(ids).to_numpy()
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            ends = rank[both.indices.to_numpy()]
            _, label = local.components(np.arange(len(ids)), ends[: table.num_rows], ends[table.num_rows :])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(order)), ids.take(pa.array(order[label]))], ["id", "component"])

    return edges.select("u", "v").repartition(1).mapInArrow(run, f"id {kind}, component {kind}")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100, task_edges: int = TASK_EDGES) -> DataFrame:
    """``(id, component)`` for every node that an edge touches; direction is ignored.

    ``component`` is the smallest id that can be reached. Up to ``task_edges`` edges go to one task. Of a larger graph
    each round contracts it: a node joins the neighbour
    (or itself) that comes first in the order of hashes, then that one's choice, and edges inside a joined
    group go. With that order groups stay shallow and the graph shrinks by a constant factor however ids are
    laid out; what is settled is never read again. At the end the choices are followed back from the last round to
    the first. Ids may be of any type with an order. Joins are by merging: rounds are many, and the driver would
    hold a table for each that is broadcast.
    """
    one = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    one = cut(one)
    if one.count() <= task_edges:
        return cut(in_one_task(one))
    rest = cut(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    chosen: list[DataFrame] = []
    order = lambda c: F.struct(F.xxhash64(F.col(c)).alias("h"), F.col(c).alias("id"))
    for _ in range(max_rounds):
        if rest.isEmpty():
            break
        first = rest.groupBy("u").agg(F.min(order("v")).alias("near")).select(F.col("u").alias("id"), F.least(order("u"), "near")["id"].alias("to"))
        first = cut(first)
        jump = first.join(first.select(F.col("id").alias("to"), F.col("to").alias("far")).hint("merge"), "to").select("id", F.col("far").alias("to"))
        joined = cut(jump)
        chosen.append(joined)
        a, b = joined.select(F.col("id").alias("u"), F.col("to").alias("a")), joined.select(F.col("id").alias("v"), F.col("to").alias("b"))
        rest = cut(rest.join(a.hint("merge"), "u").join(b.hint("merge"), "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not chosen:
        return rest.select(F.col("u").alias("id"), F.col("v").alias("component"))
    place = chosen[-1]
    for step in reversed(chosen[:-1]):
        later = place.select(F.col("id").alias("to"), F.col("to").alias("end"))
        place = step.join(later.hint("merge"), "to", "left").select("id", F.coalesce("end", "to").alias("to"))
    place = cut(place)
    least = place.groupBy("to").agg(F.min("id").alias("component"))
    return place.join(least.hint("merge"), "to").select("id", "component")
