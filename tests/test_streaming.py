"""Edge streams read from files, run to their end."""

from weftgraph.sources.graph import PropertyGraph
from weftgraph.streaming import edges as st

SCHEMA = "src long, dst long, type string, ts timestamp"


def stream(spark, path):
    spark.sql("""SELECT * FROM VALUES (1L, 2L, 'A', timestamp'2024-01-01 00:10:00'), (1L, 3L, 'A', timestamp'2024-01-01 00:20:00'),
        (2L, 1L, 'B', timestamp'2024-01-01 01:10:00'), (1L, 2L, 'A', timestamp'2024-01-01 00:11:00'), (9L, 9L, 'A', timestamp'2024-01-02 00:00:00') AS t(src, dst, type, ts)""").write.mode("overwrite").parquet(path)
    return spark.readStream.schema(SCHEMA).parquet(path)


def finished(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windowed_degrees(spark, tmp_path):
    out = finished(st.windowed_degrees(stream(spark, str(tmp_path / "in"))), "degrees", "complete")
    got = {(r["start"].hour, r["id"]): (r["out_degree"], r["in_degree"]) for r in out.where("start < '2024-01-02'").collect()}
    assert got == {(0, 1): (3, 0), (0, 2): (0, 2), (0, 3): (0, 1), (1, 2): (1, 0), (1, 1): (0, 1)}


def test_repeats_and_snapshots(spark, tmp_path):
    source = stream(spark, str(tmp_path / "in"))
    assert finished(st.new_edges(source), "fresh", "append").count() == 4
    graph = PropertyGraph.of_rows(spark, [(1, ["N"], {"name": "one"})], [])
    rows = finished(st.joined_with_nodes(source, graph, ["N"], ["name"]), "named", "append")
    assert rows.where("name = 'one'").count() == 3 and rows.count() == 5
    q = st.write_snapshots(source, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert graph.add_edges(spark.read.parquet(str(tmp_path / "out")).where("type = 'A'").drop("type"), "A").scan_edges(["A"]).count() == 4
