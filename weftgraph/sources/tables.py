"""Graph and triple views over the relational tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import PropertyGraph

#: Each label's ids lie in a range of their own: ordinal * 2^40 + key. Keys start at 0.
SPAN = 1 << 40
ORDINAL = {"Region": 0, "Nation": 1, "Customer": 2, "Supplier": 3, "Order": 4, "Part": 5, "User": 6, "EventType": 7, "Document": 8}


def node_id(label: str, key):
    return F.col(key).cast("long") + F.lit(ORDINAL[label] * SPAN)


def _nodes(df: DataFrame, label: str, key: str) -> DataFrame:
    return df.select(node_id(label, key).alias("id"), *df.columns)


def _edges(df: DataFrame, a: str, key_a: str, b: str, key_b: str, **props: str) -> DataFrame:
    return df.select(node_id(a, key_a).alias("src"), node_id(b, key_b).alias("dst"), *[F.col(c).alias(n) for n, c in props.items()])


@lru_cache(maxsize=16)
def commerce(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, orders, parts and users, with the edges between them.

    Nothing is read here beyond schemas: every frame is a lazy projection, so queries read only the columns
    that they use. The view is kept for each session and folder, as reading nine schemas costs more than a small query.
    """
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "orders", "part", "lineitem", "events", "documents")}
    g = PropertyGraph(spark)
    for label, table, key in (("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Order", "orders", "o_orderkey"), ("Part", "part", "p_partkey"), ("Document", "documents", "doc_id")):
        g = g.add_nodes(_nodes(t[table], label, key), [label])
    users = t["events"].select("user_id").distinct()
    g = g.add_nodes(_nodes(users, "User", "user_id"), ["User"])
    edges = (
        ("IN_REGION", "nation", "Nation", "n_nationkey", "Region", "n_regionkey", {}),
        ("LIVES_IN", "customer", "Customer", "c_custkey", "Nation", "c_nationkey", {}),
        ("BASED_IN", "supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey", {}),
        ("PLACED", "orders", "Customer", "o_custkey", "Order", "o_orderkey", {"date": "o_orderdate"}),
        ("CONTAINS", "lineitem", "Order", "l_orderkey", "Part", "l_partkey", {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "line": "l_linenumber", "supplier": "l_suppkey", "shipdate": "l_shipdate"}),
    )
    for name, table, a, ka, b, kb, props in edges:
        # a row of a table with a primary key is one edge; only order lines may repeat
        g = g.add_edges(_edges(t[table], a, ka, b, kb, **props), name, [a], [b], unique=table in ("nation", "customer", "supplier", "orders"))
    pairs = t["lineitem"].select("l_partkey", "l_suppkey").distinct()
    return g.add_edges(_edges(pairs, "Part", "l_partkey", "Supplier", "l_suppkey"), "SUPPLIED_BY", ["Part"], ["Supplier"], unique=True)


def co_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src < dst``: pairs of parts that share an order. Lines are dealt by order once, for ``distinct`` and both sides of the join."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    other = lines.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return lines.withColumnRenamed("l_partkey", "src").join(other, "l_orderkey").where("src < dst").select("src", "dst").distinct()


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, weight``: lines from a customer's nation to a supplier's, counted."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "supplier", "orders", "lineitem")}
    lines = t["lineitem"].select("l_orderkey", "l_suppkey").join(t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    nations = lines.join(t["customer"].select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("src")), "o_custkey").join(t["supplier"].select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst")), "l_suppkey")
    return nations.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
