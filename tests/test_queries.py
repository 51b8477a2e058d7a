"""Every registered graph query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from weftgraph import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return (None if math.isnan(v) else round(v, 5)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    res = con.execute(queries.ORACLE[name])
    at = [d[0] for d in res.description]
    assert sorted(at) == names
    want = sorted((tuple(plain(r[at.index(c)]) for c in names) for r in res.fetchall()), key=repr)
    assert got == want


def test_queries_without_sql_run(spark):
    for name in ("kcore", "louvain", "mst_weight", "max_flow"):
        assert queries.QUERIES[name](spark, SF).count() >= 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries.QUERIES["expand_1hop"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,100000.0)" in plan or "GreaterThan(o_totalprice" in plan
    assert "o_orderpriority" not in plan and "c_acctbal" not in plan


def test_queries_without_sql_see_every_order(spark, tmp_path):
    """A triangle of parts 1, 2, 3 and the bridge 3 - 4, from orders whose keys no round number divides."""
    lines = [(7, 1), (7, 2), (7, 3), (13, 3), (13, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r["id"]: r["core"] for r in run("kcore")} == {1: 2, 2: 2, 3: 2, 4: 1}
    assert {r["id"]: r["score"] for r in run("closeness")} == {1: 0.75, 2: round(2 / 3, 9), 3: 1.0, 4: 0.0}
    assert {r["id"]: r["score"] for r in run("betweenness")} == {1: 0.0, 2: 0.0, 3: round(2 / 3, 12), 4: 0.0}
    assert [r["id"] for r in run("articulation_points")] == [3]
    assert [sorted(r) for r in run("bridges")] == [[3, 4]]
    assert {r["id"] for r in run("louvain")} == {r["id"] for r in run("label_propagation")} == {1, 2, 3, 4}
