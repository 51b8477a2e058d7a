"""Edge streams: the batch graph operators' counterparts for edges that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import PropertyGraph


def windowed_degrees(edges: DataFrame, time: str = "ts", window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """``start, id, out_degree, in_degree`` for each tumbling window of an edge stream ``src, dst, <time>``.

    Both ends of an edge are counted in one grouping; edges later than ``lateness`` are dropped with their
    window's state, so state is bounded by the nodes of the open windows.
    """
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    each = edges.withWatermark(time, lateness).select(time, F.explode(ends).alias("e"))
    grouped = each.groupBy(F.window(time, window).alias("w"), F.col("e.id").alias("id"))
    return grouped.agg(F.sum("e.o").cast("bigint").alias("out_degree"), F.sum("e.i").cast("bigint").alias("in_degree")).select("w.start", "id", "out_degree", "in_degree")


def new_edges(edges: DataFrame, time: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """An edge stream without repeats of ``src, dst, type`` inside the watermark."""
    return edges.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["src", "dst", "type"])


def joined_with_nodes(edges: DataFrame, graph: PropertyGraph, labels: list[str], properties: list[str]) -> DataFrame:
    """A stream-static join: each arriving edge with properties of its source node."""
    nodes = graph.scan_nodes(labels)
    return edges.join(nodes.select(F.col("id").alias("src"), *properties), "src", "left")


def write_snapshots(edges: DataFrame, path: str, checkpoint: str):
    """Append an edge stream to a Parquet folder by type; :meth:`PropertyGraph.add_edges` reads it as a frame."""
    return edges.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("type").outputMode("append").trigger(availableNow=True).start()
