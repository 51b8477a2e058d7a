"""The triple store: a set of triples in named graphs."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TERM = "struct<kind: string, value: string, datatype: string, lang: string>"
SCHEMA = f"s {TERM}, p string, o {TERM}, g string"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def term(kind: str, value, datatype: str | Column = "", lang: str | Column = "") -> Column:
    own = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(kind).alias("kind"), own(value).cast("string").alias("value"), own(datatype).alias("datatype"), own(lang).alias("lang"))


def iri(value) -> Column:
    return term("iri", value)


def literal(value, datatype: str = "", lang: str = "") -> Column:
    return term("lit", value, "" if datatype == XSD + "string" else datatype, lang)


@dataclass(frozen=True)
class TripleStore:
    spark: SparkSession
    df: DataFrame
    graphs: frozenset[str] = frozenset()

    @staticmethod
    def empty(spark: SparkSession) -> TripleStore:
        return TripleStore(spark, spark.createDataFrame([], SCHEMA))

    def of(self, graph: str | None) -> DataFrame:
        """The triples of a named graph; of the default graph for None."""
        return self.df.where(F.col("g") == (graph or ""))

    def insert(self, rows: DataFrame) -> TripleStore:
        """Set semantics: a triple that is there already stays one."""
        return replace(self, df=self.df.unionByName(rows).dropDuplicates(["s", "p", "o", "g"]))

    def delete(self, rows: DataFrame) -> TripleStore:
        return replace(self, df=self.df.join(rows.select("s", "p", "o", "g").distinct(), ["s", "p", "o", "g"], "left_anti"))

    def save(self, path: str) -> None:
        """A snapshot in a folder of its own, split by predicate; the list of snapshots gets it when it is whole."""
        version = max([0, *snapshots(self.spark, path)]) + 1
        rows = self.df.select("s", F.col("p"), "o", "g")
        rows.write.partitionBy("p").parquet(f"{path}/v{version}") if not rows.isEmpty() else rows.write.parquet(f"{path}/v{version}")
        graphs = sorted(self.graphs)
        self.spark.createDataFrame([(version, graphs)], "version int, graphs array<string>").coalesce(1).write.mode("append").json(f"{path}/snapshots")

    @staticmethod
    def open(spark: SparkSession, path: str) -> TripleStore:
        found = snapshots(spark, path)
        if not found:
            raise FileNotFoundError(f"no triples at {path}")
        version = max(found)
        return TripleStore(spark, spark.read.schema(SCHEMA).parquet(f"{path}/v{version}").select("s", "p", "o", "g"), frozenset(found[version]))

    @staticmethod
    def of_triples(spark: SparkSession, triples: list[tuple]) -> TripleStore:
        """From ``(subject IRI, predicate IRI, object)``; objects: ``<iri>`` strings, or Python literals."""
        rows = []
        for s, p, o in triples:
            if isinstance(o, str) and o.startswith("<"):
                obj = ("iri", o[1:-1], "", "")
            elif isinstance(o, bool):
                obj = ("lit", str(o).lower(), XSD + "boolean", "")
            elif isinstance(o, (int, float)):
                obj = ("lit", str(o), XSD + ("integer" if isinstance(o, int) else "double"), "")
            else:
                obj = ("lit", o, "", "")
            rows.append((("iri", s, "", ""), p, obj, ""))
        return TripleStore.empty(spark).insert(spark.createDataFrame(rows, SCHEMA))


def snapshots(spark: SparkSession, path: str) -> dict[int, list[str]]:
    """Versions that were saved at a path, with the names of their graphs."""
    try:
        return {r["version"]: r["graphs"] or [] for r in spark.read.schema("version int, graphs array<string>").json(f"{path}/snapshots").collect()}
    except AnalysisException:
        return {}


def read_ntriples(spark: SparkSession, path: str, graph: str = "") -> DataFrame:
    """N-Triples lines as triples, by built-in regular expressions."""
    line = F.col("value")
    pattern = r'^\s*(?:<([^>]*)>|_:(\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|_:(\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*$'
    m = [F.regexp_extract(line, pattern, k) for k in range(9)]
    lines = spark.read.text(path).where(F.regexp_like(line, F.lit(pattern)))
    subject = F.when(m[2] != "", term("bnode", m[2])).otherwise(iri(m[1]))
    text = reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), [('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\\\", "\\")], m[6])
    datatype = F.when(m[7] == XSD + "string", "").otherwise(m[7])
    obj = F.when(m[4] != "", iri(m[4])).when(m[5] != "", term("bnode", m[5])).otherwise(term("lit", text, datatype, m[8]))
    return lines.select(subject.cast(TERM).alias("s"), m[3].alias("p"), obj.cast(TERM).alias("o"), F.lit(graph).alias("g"))


def rows(df: DataFrame, subject: Column, pairs: dict[str, Column], graph: str = "") -> DataFrame:
    """Triples of one table: a subject and a column for each predicate; nulls give no triple. One scan."""
    parts = [F.struct(F.lit(p).alias("p"), o.cast(TERM).alias("o")) for p, o in pairs.items()]
    each = df.select(subject.cast(TERM).alias("s"), F.explode(F.array(*parts)).alias("t"))
    return each.where("t.o.value is not null").select("s", "t.p", "t.o", F.lit(graph).alias("g"))


@lru_cache(maxsize=16)
def commerce(spark: SparkSession, sf_dir: str, base: str = "http://example.org/") -> TripleStore:
    """Customers, nations, regions and orders as triples."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "orders")}
    thing = lambda kind, key: iri(F.concat(F.lit(f"{base}{kind}/"), F.col(key).cast("string")))
    number = lambda c, dt: literal(F.col(c).cast("string"), XSD + dt)
    tables = [
        rows(t["region"], thing("region", "r_regionkey"), {TYPE: iri(F.lit(base + "Region")), base + "name": literal(F.col("r_name"))}),
        rows(t["nation"], thing("nation", "n_nationkey"), {TYPE: iri(F.lit(base + "Nation")), base + "name": literal(F.col("n_name")), base + "region": thing("region", "n_regionkey")}),
        rows(t["customer"], thing("customer", "c_custkey"), {TYPE: iri(F.lit(base + "Customer")), base + "name": literal(F.col("c_name")), base + "segment": literal(F.col("c_mktsegment")), base + "balance": number("c_acctbal", "double"), base + "nation": thing("nation", "c_nationkey")}),
        rows(t["orders"], thing("order", "o_orderkey"), {TYPE: iri(F.lit(base + "Order")), base + "customer": thing("customer", "o_custkey"), base + "total": number("o_totalprice", "double"), base + "priority": literal(F.col("o_orderpriority"))}),
    ]
    return TripleStore(spark, reduce(DataFrame.unionAll, tables))
