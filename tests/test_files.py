"""Loading and dumping graphs."""

from weftgraph.session import Database
from weftgraph.sources import files
from weftgraph.sources.graph import PropertyGraph


def test_round_trip(spark, tmp_path):
    g = PropertyGraph.of_rows(spark, [(1, ["A"], {"x": 1}), (2, ["A"], {"x": None})], [(1, 2, "E", {"w": 0.5})])
    for format in ("csv", "json", "parquet"):
        out = str(tmp_path / format)
        files.dump(g, out, format)
        new = files.load_nodes(PropertyGraph(spark), f"{out}/nodes/A-0", ["A"], format=format)
        new = files.load_edges(new, f"{out}/edges/E-0", "E", format=format, from_labels=["A"], to_labels=["A"])
        db = Database(spark, new)
        assert [tuple(r) for r in db.execute_cypher("MATCH (a:A)-[e:E]->(b:A) RETURN a.x, e.w, b.x").collect()] == [(1, 0.5, None)]


def test_other_libraries(spark):
    class Lines:
        """What such a graph object offers."""

        def nodes(self, data=False):
            return [("a", {}), ("b", {"n": 2})] if data else ["a", "b"]

        def edges(self, data=False):
            return [("a", "b", {"weight": 3})]

        def is_directed(self):
            return False

    db = Database(spark, files.from_networkx(spark, Lines()))
    assert sorted(map(tuple, db.execute_cypher("MATCH (a)-[e:EDGE]->(b) RETURN a.name, b.name, e.weight").collect())) == [("a", "b", 3), ("b", "a", 3)]
