"""Registered queries over the relational tables seen as a graph or as triples, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .algo.components import connected_components
from .algo.library import Algorithms
from .functions.aggregates import aggregate
from .operators.joins import combine
from .plans.lineage import new_folder
from .session import Database
from .sources import files, rdf, tables
from .sources.graph import PropertyGraph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def graph(spark: SparkSession, sf_dir: str) -> Database:
    return Database(spark, tables.commerce(spark, sf_dir))


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def cypher(name: str, text: str, sql: str, params: dict | None = None, **options) -> None:
    _add(name, lambda s, d: Database(s, tables.commerce(s, d), **options).execute_cypher(text, params), sql)


def gql(name: str, text: str, sql: str, params: dict | None = None) -> None:
    _add(name, lambda s, d: graph(s, d).execute(text, params), sql)


def gremlin(name: str, text: str, columns: dict[str, str], sql: str) -> None:
    """``columns``: result columns from the traversal's ``value`` (or key and value)."""
    _add(name, lambda s, d: graph(s, d).execute_gremlin(text).select(*[F.expr(e).alias(n) for n, e in columns.items()]), sql)


def graphql(name: str, text: str, sql: str) -> None:
    _add(name, lambda s, d: graph(s, d).execute_graphql(text), sql)


PREFIX = "PREFIX ex: <http://example.org/> "


def sparql(name: str, text: str, sql: str) -> None:
    _add(name, lambda s, d: Database(s, triples=rdf.commerce(s, d)).execute_sparql(PREFIX + text), sql)


def updated(name: str, updates: list[str], query: str, sql: str) -> None:
    """Updates, then a query of the changed graph."""

    def run(s: SparkSession, d: str) -> DataFrame:
        db = graph(s, d)
        for u in updates:
            db.execute_cypher(u)
        return db.execute_cypher(query)

    _add(name, run, sql)


def sparql_updated(name: str, updates: list[str], query: str, sql: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        db = Database(s, triples=rdf.commerce(s, d))
        for u in updates:
            db.execute_sparql(PREFIX + u)
        return db.execute_sparql(PREFIX + query)

    _add(name, run, sql)


# -- scans, filters, projection -------------------------------------------------------------------------------

cypher("scan_label", "MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_name AS name", "SELECT c_custkey AS k, c_name AS name FROM customer")
cypher("scan_all_labels", "MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n", "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events")
cypher("scan_edges", "MATCH ()-[r:PLACED]->() RETURN type(r) AS t, count(r) AS n", "SELECT 'PLACED' AS t, count(*) AS n FROM orders")
cypher("filter_range", "MATCH (o:Order) WHERE o.o_totalprice > 450000 AND o.o_orderstatus <> 'F' RETURN o.o_orderkey AS k, o.o_totalprice AS price", "SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_totalprice > 450000 AND o_orderstatus <> 'F'")
cypher("filter_params", "MATCH (p:Part) WHERE p.p_size IN [1, 5, 9] AND p.p_retailprice < $top RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size IN (1, 5, 9) AND p_retailprice < 1200.0", {"top": 1200.0})
cypher("inline_properties", "MATCH (c:Customer {c_mktsegment: 'BUILDING'}) RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
cypher("project_expressions", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size * 2 + 1 AS a, p.p_size / 7 AS d, p.p_size % 7 AS m, -p.p_size AS neg, p.p_size ^ 2 AS sq", "SELECT p_partkey AS k, p_size * 2::BIGINT + 1 AS a, (p_size // 7)::BIGINT AS d, (p_size % 7)::BIGINT AS m, -p_size AS neg, power(p_size, 2) AS sq FROM part")
cypher("distinct", "MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS seg, c.c_nationkey AS nation", "SELECT DISTINCT c_mktsegment AS seg, c_nationkey AS nation FROM customer")
cypher("skip_limit", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY o.o_totalprice DESC, o.o_orderkey SKIP 10 LIMIT 25", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
cypher("top_k_by_expression", "MATCH (c:Customer) RETURN c.c_name AS name ORDER BY c.c_acctbal * -1, c.c_name LIMIT 10", "SELECT c_name AS name FROM customer ORDER BY c_acctbal * -1, c_name LIMIT 10")
cypher("order_nulls", "MATCH (c:Customer) WITH c.c_custkey AS k, CASE WHEN c.c_acctbal > 5000 THEN c.c_acctbal END AS b RETURN k, b ORDER BY b DESC, k LIMIT 20", "SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS b FROM customer ORDER BY b DESC NULLS FIRST, k LIMIT 20")
cypher("unwind", "UNWIND [1, 2, 3, 4] AS x UNWIND [10, 20] AS y RETURN x, y, x * y AS xy", "SELECT x::BIGINT AS x, y::BIGINT AS y, (x * y)::BIGINT AS xy FROM (SELECT unnest([1, 2, 3, 4]) AS x), (SELECT unnest([10, 20]) AS y)")
cypher("unwind_rows", "MATCH (n:Nation) UNWIND split(n.n_name, '_') AS w RETURN n.n_nationkey AS k, w", "SELECT n_nationkey AS k, unnest(string_split(n_name, '_')) AS w FROM nation")
cypher("case_expr", "MATCH (p:Part) RETURN CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'middle' ELSE 'large' END AS size, CASE p.p_type WHEN 'x' THEN 1 ELSE 0 END AS x, count(*) AS n", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size, (CASE p_type WHEN 'x' THEN 1 ELSE 0 END)::BIGINT AS x, count(*) AS n FROM part GROUP BY 1, 2")
cypher("string_predicates", "MATCH (c:Customer) WHERE c.c_name STARTS WITH 'C' AND c.c_name ENDS WITH '7' AND c.c_name CONTAINS '1' RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_name LIKE 'C%7' AND contains(c_name, '1')")
cypher("string_regex", "MATCH (c:Customer) WHERE c.c_name =~ '[13]+5$' OR c.c_name LIKE '%99%' RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE regexp_matches(c_name, '[13]+5$') OR c_name LIKE '%99%'")
cypher("string_functions", "MATCH (p:Part) RETURN p.p_partkey AS k, size(p.p_name) AS n, reverse(p.p_brand) AS r, toUpper(p.p_type) AS u, substring(p.p_brand, 0, 3) AS s, toString(p.p_size) AS t, p.p_brand + '/' + p.p_type AS c", "SELECT p_partkey AS k, length(p_name) AS n, reverse(p_brand) AS r, upper(p_type) AS u, substr(p_brand, 1, 3) AS s, p_size::VARCHAR AS t, p_brand || '/' || p_type AS c FROM part")
cypher("conversions", "MATCH (p:Part) RETURN p.p_partkey AS k, toInteger(p.p_retailprice) AS i, toFloat(p.p_size) AS f, toBoolean('TRUE') AS b, toInteger('x') AS x, coalesce(toFloat('y'), 1.5) AS y", "SELECT p_partkey AS k, trunc(p_retailprice)::BIGINT AS i, p_size::DOUBLE AS f, TRUE AS b, NULL::BIGINT AS x, 1.5::DOUBLE AS y FROM part")
cypher("list_functions", "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, 3, 7, 11] AS l RETURN k, head(l) AS h, last(l) AS z, size(tail(l)) AS t, l[1] AS one, l[-2] AS two, size(l[1..3]) AS part, l[9] AS none, size([x IN l WHERE x > 5 | x * 2]) AS many, 7 IN l AS seven", "SELECT p_partkey AS k, p_size::BIGINT AS h, 11::BIGINT AS z, 3::BIGINT AS t, 3::BIGINT AS one, 7::BIGINT AS two, 2::BIGINT AS part, NULL::BIGINT AS none, (2 + (CASE WHEN p_size > 5 THEN 1 ELSE 0 END))::BIGINT AS many, TRUE AS seven FROM part")
cypher("boolean_logic", "MATCH (o:Order) WHERE (o.o_orderstatus = 'F' XOR o.o_totalprice > 250000) AND NOT o.o_orderpriority = '1-URGENT' RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE ((o_orderstatus = 'F') <> (o_totalprice > 250000)) AND NOT o_orderpriority = '1-URGENT'")
cypher("null_tests", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 WITH c, o WHERE o IS NULL RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")

# -- patterns -------------------------------------------------------------------------------------------------

cypher("expand_1hop", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000 RETURN c.c_mktsegment AS seg, count(o) AS n ORDER BY n DESC", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1")
cypher("expand_in", "MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) RETURN n.n_name AS nation, count(c) AS n", "SELECT n_name AS nation, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
cypher("expand_both", "MATCH (n:Nation)-[]-(m) RETURN n.n_name AS nation, labels(m)[0] AS label, count(*) AS n", "SELECT n_name AS nation, label, count(*) AS n FROM nation JOIN (SELECT c_nationkey AS k, 'Customer' AS label FROM customer UNION ALL SELECT s_nationkey, 'Supplier' FROM supplier UNION ALL SELECT n_nationkey, 'Region' FROM nation) ON k = n_nationkey GROUP BY 1, 2")
cypher("expand_types", "MATCH (n:Nation)<-[r:LIVES_IN|BASED_IN]-(x) RETURN type(r) AS t, n.n_nationkey AS k, count(*) AS n", "SELECT 'LIVES_IN' AS t, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'BASED_IN', s_nationkey, count(*) FROM supplier GROUP BY 2")
cypher("expand_3hop", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.r_name AS region, count(o) AS n, round(sum(o.o_totalprice)) AS total", "SELECT r_name AS region, count(*) AS n, round(sum(o_totalprice)) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
cypher("edge_properties", "MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.quantity >= 49 AND p.p_size = 1 RETURN o.o_orderkey AS o, p.p_partkey AS p, r.quantity AS q, r.line AS line", "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS q, l_linenumber AS line FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49 AND p_size = 1")
cypher("edge_inline_properties", "MATCH (o:Order)-[:CONTAINS {line: 1}]->(p:Part) RETURN count(*) AS n", "SELECT count(*) AS n FROM lineitem WHERE l_linenumber = 1")
cypher("cyclic_pattern", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part)-[:SUPPLIED_BY]->(s:Supplier)-[:BASED_IN]->(n:Nation)<-[:LIVES_IN]-(c) RETURN n.n_name AS nation, count(*) AS n", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem) ps ON ps.pk = l.l_partkey JOIN supplier ON s_suppkey = ps.sk JOIN nation ON n_nationkey = s_nationkey WHERE c_nationkey = s_nationkey GROUP BY 1")
cypher("comma_patterns", "MATCH (a:Supplier)-[:BASED_IN]->(n:Nation), (b:Customer)-[:LIVES_IN]->(n) WHERE a.s_acctbal > b.c_acctbal RETURN n.n_nationkey AS k, count(*) AS n", "SELECT s_nationkey AS k, count(*) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_acctbal > c_acctbal GROUP BY 1")
cypher("two_matches", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) MATCH (n)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, count(c) AS n", "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
cypher("cross_product", "MATCH (r:Region), (n:Nation) RETURN count(*) AS n", "SELECT count(*) AS n FROM region, nation")
cypher("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 RETURN c.c_custkey AS k, count(o) AS n, max(o.o_totalprice) AS top", "SELECT c_custkey AS k, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY 1")
cypher("optional_unmatched", "MATCH (o:Order) OPTIONAL MATCH (o)-[r:CONTAINS]->(:Part) RETURN o.o_orderkey AS k, count(r) AS n", "SELECT o_orderkey AS k, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
cypher("exists_semi", "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 } RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
cypher("not_exists_anti", "MATCH (o:Order) WHERE NOT EXISTS { (o)-[:CONTAINS]->() } RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
cypher("exists_correlated", "MATCH (s:Supplier) WHERE EXISTS { MATCH (s)-[:BASED_IN]->(n:Nation)<-[:LIVES_IN]-(c:Customer) WHERE c.c_acctbal > 9900 + s.s_acctbal / 1000 } RETURN s.s_suppkey AS k", "SELECT s_suppkey AS k FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9900 + s_acctbal / 1000)")
cypher("exists_in_or", "MATCH (c:Customer) WHERE c.c_acctbal > 9900 OR EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 490000 } RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9900 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)")
cypher("count_subquery", "MATCH (n:Nation) RETURN n.n_nationkey AS k, COUNT { (n)<-[:BASED_IN]-(:Supplier) } AS s", "SELECT n_nationkey AS k, count(s_suppkey) AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
cypher("varlen_1_3", "MATCH (s:Supplier)-[r*1..3]->(x) RETURN labels(x)[0] AS label, size(r) AS hops, count(*) AS n", "SELECT 'Nation' AS label, 1::BIGINT AS hops, count(*) AS n FROM supplier UNION ALL SELECT 'Region', 2, count(*) FROM supplier")
cypher("varlen_0_2", "MATCH (n:Nation {n_nationkey: 3})-[*0..2]->(x) RETURN labels(x)[0] AS label, count(*) AS n", "SELECT 'Nation' AS label, 1::BIGINT AS n UNION ALL SELECT 'Region', 1")
cypher("varlen_both", "MATCH (a:Region {r_regionkey: 1})-[:IN_REGION|BASED_IN*1..3]-(x) RETURN labels(x)[0] AS label, count(*) AS n", "SELECT 'Nation' AS label, count(*) AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'Supplier', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
cypher("varlen_open", "MATCH p = (c:Customer {c_custkey: 7})-[:PLACED|CONTAINS|SUPPLIED_BY|BASED_IN*]->(x) RETURN length(p) AS hops, count(*) AS n", "WITH o AS (SELECT o_orderkey k FROM orders WHERE o_custkey = 7), l AS (SELECT l_partkey p FROM lineitem JOIN o ON l_orderkey = k), ps AS (SELECT DISTINCT l_partkey p, l_suppkey s FROM lineitem), s AS (SELECT s FROM l JOIN ps USING (p)) SELECT 1::BIGINT AS hops, count(*) AS n FROM o UNION ALL SELECT 2, count(*) FROM l UNION ALL SELECT 3, count(*) FROM s UNION ALL SELECT 4, count(*) FROM s")
cypher("path_length", "MATCH p = (c:Customer)-[:LIVES_IN]->(:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_regionkey AS k, length(p) AS len, count(*) AS n", "SELECT n_regionkey AS k, 2::BIGINT AS len, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
cypher("shortest_path", "MATCH (a:Supplier), (b:Region) MATCH p = shortestPath((a)-[:BASED_IN|IN_REGION*]-(b)) RETURN a.s_suppkey AS s, b.r_regionkey AS r, length(p) AS len", "SELECT s_suppkey AS s, r_regionkey AS r, CASE WHEN n_regionkey = r_regionkey THEN 2::BIGINT END AS len FROM supplier JOIN nation ON n_nationkey = s_nationkey, region")
cypher("all_shortest_paths", "MATCH (a:Nation {n_nationkey: 4}), (p:Part) MATCH q = allShortestPaths((p)-[:SUPPLIED_BY|BASED_IN*]->(a)) RETURN p.p_partkey AS p, length(q) AS len", "SELECT p_partkey AS p, 2::BIGINT AS len FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 4 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 4)")

# -- aggregation ----------------------------------------------------------------------------------------------

cypher("agg_global", "MATCH (o:Order) RETURN count(*) AS n, count(DISTINCT o.o_custkey) AS d, round(sum(o.o_totalprice)) AS s, round(avg(o.o_totalprice), 4) AS a, min(o.o_totalprice) AS lo, max(o.o_totalprice) AS hi", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS d, round(sum(o_totalprice)) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
cypher("agg_group", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_mktsegment AS seg, o.o_orderpriority AS pri, count(*) AS n, sum(o.o_orderkey) AS keys", "SELECT c_mktsegment AS seg, o_orderpriority AS pri, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
cypher("agg_by_node", "MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) WITH n, count(c) AS k WHERE k > 55 RETURN n.n_name AS name, k", "SELECT n_name AS name, count(*) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name HAVING count(*) > 55")
cypher("agg_empty", "MATCH (c:Customer) WHERE c.c_custkey < 0 RETURN count(c) AS n, sum(c.c_custkey) AS s, avg(c.c_acctbal) AS a, min(c.c_name) AS m, size(collect(c.c_name)) AS l", "SELECT 0::BIGINT AS n, 0::BIGINT AS s, NULL::DOUBLE AS a, NULL::VARCHAR AS m, 0::BIGINT AS l")
cypher("agg_distinct", "MATCH (p:Part) RETURN p.p_brand AS b, sum(DISTINCT p.p_size) AS s, round(avg(DISTINCT p.p_size), 6) AS a, count(DISTINCT p.p_type) AS t", "SELECT p_brand AS b, sum(DISTINCT p_size)::BIGINT AS s, round(avg(DISTINCT p_size), 6) AS a, count(DISTINCT p_type) AS t FROM part GROUP BY 1")
cypher("agg_collect", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.r_regionkey AS k, size(collect(n.n_name)) AS n, size(collect(DISTINCT n.n_regionkey)) AS d", "SELECT n_regionkey AS k, count(*) AS n, 1::BIGINT AS d FROM nation GROUP BY 1")
cypher("agg_stdev", "MATCH (c:Customer) RETURN c.c_nationkey AS k, round(stdev(c.c_acctbal), 4) AS s, round(stdevp(c.c_acctbal), 4) AS p", "SELECT c_nationkey AS k, round(stddev_samp(c_acctbal), 4) AS s, round(stddev_pop(c_acctbal), 4) AS p FROM customer GROUP BY 1")
cypher("percentile_disc", "MATCH (p:Part) RETURN p.p_brand AS b, percentileDisc(p.p_retailprice, 0.9) AS x, percentileDisc(p.p_size, 0.25) AS y", "SELECT p_brand AS b, list_sort(list(p_retailprice))[floor(0.9 * (count(*) - 1))::INT + 1] AS x, list_sort(list(p_size::DOUBLE))[floor(0.25 * (count(*) - 1))::INT + 1] AS y FROM part GROUP BY 1")
cypher("percentile_cont", "MATCH (p:Part) RETURN p.p_brand AS b, round(percentileCont(p.p_retailprice, 0.9), 6) AS x", "SELECT p_brand AS b, round(quantile_cont(p_retailprice, 0.9), 6) AS x FROM part GROUP BY 1")
gql("having", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_custkey AS k, count(o) AS n HAVING n > 18", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 18")
cypher("agg_expression", "MATCH (o:Order)-[r:CONTAINS]->(:Part) RETURN o.o_orderstatus AS st, round(sum(r.price * (1 - r.discount)) / 1000) AS revenue, count(*) + 1 AS n1", "SELECT o_orderstatus AS st, round(sum(l_extendedprice * (1 - l_discount)) / 1000) AS revenue, count(*) + 1 AS n1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
cypher("with_chain", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n ORDER BY n DESC, c.c_custkey LIMIT 20 MATCH (c)-[:LIVES_IN]->(x:Nation) RETURN x.n_name AS nation, count(c) AS customers, sum(n) AS orders", "WITH t AS (SELECT o_custkey k, count(*) n FROM orders GROUP BY 1 ORDER BY n DESC, k LIMIT 20) SELECT n_name AS nation, count(*) AS customers, sum(n)::BIGINT AS orders FROM t JOIN customer ON c_custkey = k JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
cypher("union_all", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
cypher("union_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")

# -- the same question in other languages -----------------------------------------------------------------------

gql("gql_expand", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 RETURN c.c_mktsegment AS seg, count(o) AS n", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000 GROUP BY 1")
gql("gql_target_label", "MATCH (n:Nation)<-[]-(s:Supplier) RETURN n.n_nationkey AS k, count(s) AS n", "SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1")
gql("gql_quantifier", "MATCH (s:Supplier)-[]->{2,2}(r:Region) RETURN r.r_name AS r, count(*) AS n", "SELECT r_name AS r, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
gremlin("gremlin_out_count", "g.V().hasLabel('Customer').out('PLACED').has('o_totalprice', gt(300000)).count()", {"n": "value"}, "SELECT count(*) AS n FROM orders WHERE o_totalprice > 300000")
gremlin("gremlin_values", "g.V().hasLabel('Nation').has('n_regionkey', within(1, 2)).values('n_name')", {"name": "value"}, "SELECT n_name AS name FROM nation WHERE n_regionkey IN (1, 2)")
gremlin("gremlin_group_count", "g.V().hasLabel('Customer').groupCount().by('c_mktsegment')", {"seg": "key", "n": "value"}, "SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1")
gremlin("gremlin_group_sum", "g.V().hasLabel('Part').group().by('p_brand').by(values('p_size').sum())", {"brand": "key", "size": "value"}, "SELECT p_brand AS brand, sum(p_size)::BIGINT AS size FROM part GROUP BY 1")
gremlin("gremlin_where_not", "g.V().hasLabel('Order').not(__.out('CONTAINS')).values('o_orderkey')", {"k": "value"}, "SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
gremlin("gremlin_where", "g.V().hasLabel('Customer').where(__.out('PLACED').has('o_totalprice', gt(400000))).count()", {"n": "value"}, "SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_totalprice > 400000")
gremlin("gremlin_edges", "g.E().hasLabel('CONTAINS').has('quantity', between(10, 12)).count()", {"n": "value"}, "SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12")
gremlin("gremlin_select", "g.V().hasLabel('Supplier').as('s').out('BASED_IN').as('n').select('s', 'n').by('s_name').by('n_name')", {"s": "value.s", "n": "value.n"}, "SELECT s_name AS s, n_name AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey")
gremlin("gremlin_order_limit", "g.V().hasLabel('Customer').order().by('c_acctbal', desc).by('c_custkey').limit(12).values('c_custkey')", {"k": "value"}, "SELECT c_custkey AS k FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12")
gremlin("gremlin_repeat", "g.V().hasLabel('Supplier').repeat(out()).times(2).dedup().values('r_name')", {"r": "value"}, "SELECT DISTINCT r_name AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
gremlin("gremlin_union", "g.V().hasLabel('Nation').union(__.in('LIVES_IN'), __.in('BASED_IN')).count()", {"n": "value"}, "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n")
gremlin("gremlin_project", "g.V().hasLabel('Nation').project('name', 'suppliers').by('n_name').by(__.in('BASED_IN').count())", {"name": "value.name", "suppliers": "value.suppliers"}, "SELECT n_name AS name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
gremlin("gremlin_mean", "g.V().hasLabel('Part').values('p_size').mean()", {"m": "round(value, 6)"}, "SELECT round(avg(p_size), 6) AS m FROM part")
graphql("graphql_nested", "{ supplier(s_acctbal_gt: 5000) { s_suppkey BASED_IN { n_name IN_REGION { r_name } } } }", "SELECT s_suppkey, n_name AS BASED_IN_n_name, r_name AS BASED_IN_IN_REGION_r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_acctbal > 5000")
graphql("graphql_order", "{ customer(where: {c_mktsegment: \"BUILDING\", c_acctbal_gte: 1000}, orderBy: {c_custkey: DESC}, first: 15) { key: c_custkey c_name } }", "SELECT c_custkey AS key, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 ORDER BY c_custkey DESC LIMIT 15")
graphql("graphql_fragment", "query Q { nation(n_name_contains: \"1\") { ...F } } fragment F on Nation { n_nationkey n_name }", "SELECT n_nationkey, n_name FROM nation WHERE contains(n_name, '1')")
_add("graphql_rdf", lambda s, d: Database(s, triples=rdf.commerce(s, d)).execute_graphql_rdf("{ customer(balance_gt: 9000) { name nation { name } } }"), "SELECT c_name AS name, n_name AS nation_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000")

# -- SPARQL -------------------------------------------------------------------------------------------------------

sparql("sparql_bgp", "SELECT ?c ?n WHERE { ?x a ex:Customer ; ex:name ?c ; ex:nation ?y . ?y ex:name ?n }", "SELECT c_name AS c, n_name AS n FROM customer JOIN nation ON n_nationkey = c_nationkey")
sparql("sparql_filter", "SELECT ?c WHERE { ?x a ex:Customer ; ex:name ?c ; ex:balance ?b ; ex:segment ?s FILTER(?b > 5000 && (?s = \"BUILDING\" || REGEX(?c, \"9$\"))) }", "SELECT c_name AS c FROM customer WHERE c_acctbal > 5000 AND (c_mktsegment = 'BUILDING' OR c_name LIKE '%9')")
sparql("sparql_optional", "SELECT ?c ?t WHERE { ?x a ex:Customer ; ex:name ?c OPTIONAL { ?o ex:customer ?x ; ex:total ?t FILTER(?t > 450000) } }", "SELECT c_name AS c, o_totalprice::VARCHAR AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000")
sparql("sparql_minus", "SELECT ?c WHERE { ?x a ex:Customer ; ex:name ?c MINUS { ?o ex:customer ?x ; ex:total ?t FILTER(?t > 400000) } }", "SELECT c_name AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
sparql("sparql_not_exists", "SELECT ?c WHERE { ?x a ex:Customer ; ex:name ?c FILTER NOT EXISTS { ?o ex:customer ?x ; ex:priority \"1-URGENT\" } }", "SELECT c_name AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
sparql("sparql_union", "SELECT ?n WHERE { { ?x a ex:Nation } UNION { ?x a ex:Region } ?x ex:name ?n }", "SELECT n_name AS n FROM nation UNION ALL SELECT r_name FROM region")
sparql("sparql_values_bind", "SELECT ?c ?u ?l WHERE { VALUES ?s { \"BUILDING\" \"MACHINERY\" } ?x ex:segment ?s ; ex:name ?c BIND(LCASE(?c) AS ?u) BIND(STRLEN(?s) AS ?l) }", "SELECT c_name AS c, lower(c_name) AS u, length(c_mktsegment) AS l FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
sparql("sparql_aggregate", "SELECT ?s (COUNT(?x) AS ?n) (ROUND(SUM(?b)) AS ?t) (ROUND(AVG(?b)) AS ?a) WHERE { ?x ex:segment ?s ; ex:balance ?b } GROUP BY ?s HAVING(COUNT(?x) > 10)", "SELECT c_mktsegment AS s, count(*) AS n, round(sum(c_acctbal)) AS t, round(avg(c_acctbal)) AS a FROM customer GROUP BY 1 HAVING count(*) > 10")
sparql("sparql_path_sequence", "SELECT ?c ?r WHERE { ?x a ex:Customer ; ex:name ?c ; ex:nation/ex:region/ex:name ?r }", "SELECT c_name AS c, r_name AS r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
sparql("sparql_path_closure", "SELECT ?n WHERE { <http://example.org/customer/7> (ex:nation|ex:region)+ ?y . ?y ex:name ?n }", "SELECT n_name AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7 UNION ALL SELECT r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey = 7")
sparql("sparql_path_inverse", "SELECT ?n (COUNT(?x) AS ?k) WHERE { ?y a ex:Nation ; ex:name ?n ; ^ex:nation ?x } GROUP BY ?n", "SELECT n_name AS n, count(*) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
sparql("sparql_distinct_order", "SELECT DISTINCT ?s WHERE { ?x ex:segment ?s } ORDER BY DESC(?s) LIMIT 3 OFFSET 1", "SELECT DISTINCT c_mktsegment AS s FROM customer ORDER BY 1 DESC LIMIT 3 OFFSET 1")
sparql("sparql_subselect", "SELECT ?n ?m WHERE { { SELECT ?y (MAX(?b) AS ?m) WHERE { ?x ex:nation ?y ; ex:balance ?b } GROUP BY ?y } ?y ex:name ?n }", "SELECT n_name AS n, max(c_acctbal)::VARCHAR AS m FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
sparql("sparql_ask", "ASK { ?x ex:segment \"BUILDING\" }", "SELECT count(*) > 0 AS result FROM customer WHERE c_mktsegment = 'BUILDING'")
sparql("sparql_construct", "CONSTRUCT { ?r ex:hasNation ?n } WHERE { ?n a ex:Nation ; ex:region ?r }", "SELECT 'http://example.org/region/' || n_regionkey AS subject, 'http://example.org/hasNation' AS predicate, 'http://example.org/nation/' || n_nationkey AS object FROM nation")
sparql("sparql_describe", "DESCRIBE <http://example.org/region/2>", "SELECT 'http://example.org/region/2' AS subject, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS predicate, 'http://example.org/Region' AS object UNION ALL SELECT 'http://example.org/region/2', 'http://example.org/name', r_name FROM region WHERE r_regionkey = 2")
sparql_updated("sparql_insert_delete", ["INSERT DATA { ex:me ex:name \"Me\" ; ex:segment \"BUILDING\" }", "DELETE { ?x ex:segment ?s } INSERT { ?x ex:segment \"OTHER\" } WHERE { ?x ex:segment ?s FILTER(?s = \"MACHINERY\") }", "DELETE DATA { ex:me ex:name \"Me\" }"], "SELECT ?s (COUNT(?x) AS ?n) WHERE { ?x ex:segment ?s } GROUP BY ?s", "SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'OTHER' ELSE c_mktsegment END AS s, count(*) + max(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS n FROM customer GROUP BY 1")

# -- updates ---------------------------------------------------------------------------------------------------------

updated("create_nodes_edges", ["MATCH (n:Nation) CREATE (n)-[:HAS_HUB {size: n.n_nationkey * 2}]->(h:Hub {name: n.n_name + ' hub', at: n.n_nationkey})"], "MATCH (n:Nation)-[r:HAS_HUB]->(h:Hub) RETURN n.n_name AS nation, h.name AS hub, r.size AS size", "SELECT n_name AS nation, n_name || ' hub' AS hub, n_nationkey * 2::BIGINT AS size FROM nation")
updated("set_property", ["MATCH (c:Customer) WHERE c.c_acctbal < 0 SET c.c_acctbal = 0.0, c.flag = 'debt'"], "MATCH (c:Customer) RETURN c.flag AS flag, count(*) AS n, min(c.c_acctbal) AS lo", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' END AS flag, count(*) AS n, min(CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END) AS lo FROM customer GROUP BY 1")
updated("remove_property", ["MATCH (s:Supplier) WHERE s.s_suppkey % 2 = 0 REMOVE s.s_name"], "MATCH (s:Supplier) RETURN count(s.s_name) AS named, count(*) AS n", "SELECT count(*) FILTER (s_suppkey % 2 = 1) AS named, count(*) AS n FROM supplier")
updated("set_labels", ["MATCH (c:Customer) WHERE c.c_acctbal > 9000 SET c:Rich", "MATCH (c:Rich) WHERE c.c_acctbal > 9900 REMOVE c:Customer"], "MATCH (c:Rich) RETURN size(labels(c)) AS labels, count(*) AS n", "SELECT (CASE WHEN c_acctbal > 9900 THEN 1 ELSE 2 END)::BIGINT AS labels, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1")
updated("delete_detach", ["MATCH (n:Nation) WHERE n.n_regionkey = 0 DETACH DELETE n"], "MATCH (c:Customer) OPTIONAL MATCH (c)-[:LIVES_IN]->(n:Nation) RETURN n IS NULL AS gone, count(*) AS n", "SELECT n_regionkey = 0 AS gone, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
updated("delete_edges", ["MATCH (c:Customer)-[r:PLACED]->(o:Order) WHERE o.o_totalprice > 200000 DELETE r"], "MATCH (:Customer)-[r:PLACED]->(:Order) RETURN count(r) AS n", "SELECT count(*) AS n FROM orders WHERE o_totalprice <= 200000")
updated("merge_node", ["UNWIND ['BUILDING', 'NEW'] AS s MERGE (m:Segment {name: s}) ON CREATE SET m.seen = 1", "MERGE (m:Segment {name: 'NEW'}) ON MATCH SET m.seen = 2"], "MATCH (m:Segment) RETURN m.name AS name, m.seen AS seen", "SELECT 'BUILDING' AS name, 1::BIGINT AS seen UNION ALL SELECT 'NEW', 2")


updated("merge_repeated_rows", ["UNWIND ['A', 'A', 'B'] AS s MERGE (m:Seg {name: s}) ON CREATE SET m.made = 1 ON MATCH SET m.met = 1"], "MATCH (m:Seg) RETURN m.name AS name, m.made AS made, m.met AS met", "SELECT 'A' AS name, 1::BIGINT AS made, 1::BIGINT AS met UNION ALL SELECT 'B', 1, NULL")
updated("merge_from_match", ["MATCH (c:Customer) MERGE (m:Seg {name: c.c_mktsegment})", "MATCH (c:Customer) MATCH (m:Seg {name: c.c_mktsegment}) MERGE (c)-[:IN_SEGMENT]->(m)", "MATCH (c:Customer) MATCH (m:Seg {name: c.c_mktsegment}) MERGE (c)-[:IN_SEGMENT]->(m)"], "MATCH (c:Customer)-[:IN_SEGMENT]->(m:Seg) RETURN m.name AS name, count(c) AS n", "SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY 1")
updated("set_edge_property", ["MATCH (a:Supplier)-[r:BASED_IN]->(b:Nation) WHERE b.n_regionkey = 1 SET r.w = a.s_suppkey * 2, r.kind = 'home'"], "MATCH (a:Supplier)-[r:BASED_IN]->(b:Nation) RETURN a.s_suppkey AS k, r.w AS w, r.kind AS kind", "SELECT s_suppkey AS k, CASE WHEN n_regionkey = 1 THEN s_suppkey * 2 END AS w, CASE WHEN n_regionkey = 1 THEN 'home' END AS kind FROM supplier JOIN nation ON n_nationkey = s_nationkey")
updated("remove_edge_property", ["MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE p.p_size > 25 REMOVE r.quantity", "MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE p.p_size = 1 SET r += {quantity: 0.0, tax: 1.0}"], "MATCH (o:Order)-[r:CONTAINS]->(p:Part) RETURN p.p_size AS size, count(*) AS n, count(r.quantity) AS q, sum(r.quantity) AS total, min(r.tax) AS tax", "SELECT p_size AS size, count(*) AS n, count(CASE WHEN p_size <= 25 THEN l_quantity END) AS q, coalesce(sum(CASE WHEN p_size = 1 THEN 0 WHEN p_size <= 25 THEN l_quantity END), 0) AS total, min(CASE WHEN p_size = 1 THEN 1.0 ELSE l_tax END) AS tax FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")


def _rolled_back(s: SparkSession, d: str) -> DataFrame:
    db = graph(s, d)
    db.begin()
    db.execute_cypher("MATCH (r:Region) DETACH DELETE r")
    db.rollback()
    return db.execute_cypher("MATCH (r:Region) RETURN count(*) AS n")


_add("transaction_rollback", _rolled_back, "SELECT count(*) AS n FROM region")
_add("detailed_stats", lambda s, d: graph(s, d).detailed_stats().where("kind = 'edge_type'"), "SELECT 'edge_type' AS kind, 'IN_REGION' AS name, count(*) AS n FROM nation UNION ALL SELECT 'edge_type', 'LIVES_IN', count(*) FROM customer UNION ALL SELECT 'edge_type', 'BASED_IN', count(*) FROM supplier UNION ALL SELECT 'edge_type', 'PLACED', count(*) FROM orders UNION ALL SELECT 'edge_type', 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'edge_type', 'SUPPLIED_BY', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")

# -- functions and calls that no query above uses -----------------------------------------------------------------------

cypher("to_integer_negative", "UNWIND ['-3.7', '3.7', '-4', 'x', '1e3'] AS t RETURN t, toInteger(t) AS i, toInteger(-3.7) AS j", "SELECT t, trunc(TRY_CAST(t AS DOUBLE))::BIGINT AS i, -3::BIGINT AS j FROM (SELECT unnest(['-3.7', '3.7', '-4', 'x', '1e3']) AS t)")
cypher("id_function", "MATCH (n:Nation) RETURN id(n) AS id, n.n_nationkey AS k", "SELECT n_nationkey + 1099511627776 AS id, n_nationkey AS k FROM nation")
cypher("exists_property", "MATCH (c:Customer) RETURN exists(c.c_name) AS named, exists(c.nothing) AS other, count(*) AS n", "SELECT c_name IS NOT NULL AS named, FALSE AS other, count(*) AS n FROM customer GROUP BY 1")
cypher("has_label", "MATCH (n) WHERE hasLabel(n, 'Region') OR n:Nation RETURN labels(n)[0] AS label, count(*) AS n", "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation")
cypher("map_literal", "MATCH (r:Region) WITH {key: r.r_regionkey, name: r.r_name} AS m RETURN m.key AS k, m['name'] AS name", "SELECT r_regionkey AS k, r_name AS name FROM region")
cypher("concat_operator", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_brand || '-' || p.p_type AS c", "SELECT p_partkey AS k, p_brand || '-' || p_type AS c FROM part")
cypher("quantified_predicates", "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, 20, 30] AS l RETURN k, any(x IN l WHERE x > 40) AS a, all(x IN l WHERE x > 10) AS b, none(x IN l WHERE x = 50) AS c", "SELECT p_partkey AS k, p_size > 40 AS a, p_size > 10 AS b, p_size <> 50 AS c FROM part")
cypher("percentile_global", "MATCH (o:Order) RETURN percentileDisc(o.o_totalprice, 0.37) AS x, count(*) AS n", "SELECT list_sort(list(o_totalprice))[floor(0.37 * (count(*) - 1))::INT + 1] AS x, count(*) AS n FROM orders")
sparql("sparql_group_concat", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=\"|\") AS ?all) (SAMPLE(?n) AS ?one) WHERE { ?x a ex:Nation ; ex:name ?n ; ex:region ?y . ?y ex:name ?r } GROUP BY ?r", "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS all, min(n_name) AS one FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
sparql("sparql_dates", "SELECT ?n (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?a) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?i) (SECONDS(?d) AS ?s) (TZ(?z) AS ?t) WHERE { ?x a ex:Region ; ex:name ?n BIND(\"2024-03-05T06:07:08\" AS ?d) BIND(\"2024-03-05T06:07:08Z\" AS ?z) }", "SELECT r_name AS n, 2024::BIGINT AS y, 3::BIGINT AS m, 5::BIGINT AS a, 6::BIGINT AS h, 7::BIGINT AS i, 8::BIGINT AS s, 'Z' AS t FROM region")
sparql("sparql_hashes", "SELECT ?n (MD5(?n) AS ?m) (SHA1(?n) AS ?s) (SHA256(?n) AS ?t) WHERE { ?x a ex:Nation ; ex:name ?n }", "SELECT n_name AS n, md5(n_name) AS m, sha1(n_name) AS s, sha256(n_name) AS t FROM nation")
sparql("sparql_terms", "SELECT ?n (ISIRI(?x) AS ?i) (ISLITERAL(?n) AS ?l) (ISBLANK(?x) AS ?b) (ISNUMERIC(?k) AS ?u) (DATATYPE(?k) AS ?d) (STR(IRI(CONCAT(\"urn:\", ?n))) AS ?r) (LANG(STRLANG(?n, \"en\")) AS ?g) (sameTerm(?n, ?n) AS ?e) WHERE { ?x a ex:Customer ; ex:name ?n ; ex:balance ?k }", "SELECT c_name AS n, TRUE AS i, TRUE AS l, FALSE AS b, TRUE AS u, 'http://www.w3.org/2001/XMLSchema#double' AS d, 'urn:' || c_name AS r, 'en' AS g, TRUE AS e FROM customer")
sparql("sparql_optional_chain", "SELECT ?c ?t WHERE { ?x a ex:Customer ; ex:name ?c OPTIONAL { ?o ex:customer ?x ; ex:total ?t FILTER(?t > 450000) } OPTIONAL { ?p ex:customer ?x ; ex:total ?t FILTER(?t > 400000) } }", "WITH o AS (SELECT o_custkey AS k, o_totalprice AS t FROM orders) SELECT c_name AS c, coalesce(a.t, b.t)::VARCHAR AS t FROM customer LEFT JOIN (SELECT * FROM o WHERE t > 450000) a ON a.k = c_custkey LEFT JOIN (SELECT * FROM o WHERE t > 400000) b ON b.k = c_custkey AND (a.t IS NULL OR a.t = b.t)")
sparql("sparql_loose_join", "SELECT ?n ?m WHERE { { SELECT ?t ?n WHERE { ?x a ex:Nation ; ex:name ?n OPTIONAL { ?x ex:region ?t FILTER(?t = <http://example.org/region/1>) } } } { SELECT ?t ?m WHERE { ?t a ex:Region ; ex:name ?m } } }", "SELECT n_name AS n, r_name AS m FROM nation JOIN region ON n_regionkey <> 1 OR r_regionkey = n_regionkey")
sparql_updated("sparql_delete_where", ["DELETE WHERE { ?x ex:segment \"BUILDING\" ; ex:name ?n }"], "SELECT (COUNT(?s) AS ?k) WHERE { ?x ex:segment ?s }", "SELECT count(*) AS k FROM customer WHERE c_mktsegment <> 'BUILDING'")
sparql_updated("sparql_graphs", ["CREATE GRAPH <urn:g>", "INSERT { GRAPH <urn:g> { ?x ex:name ?n } } WHERE { ?x a ex:Nation ; ex:name ?n }", "INSERT DATA { GRAPH <urn:h> { ex:a ex:name \"A\" } }"], "SELECT ?g (COUNT(?n) AS ?k) WHERE { GRAPH ?g { ?x ex:name ?n } } GROUP BY ?g", "SELECT 'urn:g' AS g, count(*) AS k FROM nation UNION ALL SELECT 'urn:h', 1")
sparql_updated("sparql_copy_move_add", ["INSERT { GRAPH <urn:g> { ?x ex:name ?n } } WHERE { ?x a ex:Region ; ex:name ?n }", "INSERT { GRAPH <urn:h> { ?x ex:name ?n } } WHERE { ?x a ex:Nation ; ex:name ?n }", "ADD <urn:g> TO <urn:h>", "COPY <urn:g> TO <urn:i>", "MOVE <urn:g> TO <urn:j>"], "SELECT ?g (COUNT(?n) AS ?k) WHERE { GRAPH ?g { ?x ex:name ?n } } GROUP BY ?g", "SELECT 'urn:h' AS g, (SELECT count(*) FROM nation) + count(*) AS k FROM region UNION ALL SELECT 'urn:i', count(*) FROM region UNION ALL SELECT 'urn:j', count(*) FROM region")
sparql_updated("sparql_clear_drop", ["INSERT { GRAPH <urn:g> { ?x ex:name ?n } GRAPH <urn:h> { ?x ex:name ?n } } WHERE { ?x a ex:Region ; ex:name ?n }", "CLEAR GRAPH <urn:g>", "DROP DEFAULT"], "SELECT ?g (COUNT(?n) AS ?k) WHERE { { GRAPH ?g { ?x ex:name ?n } } UNION { ?x ex:name ?n BIND(\"default\" AS ?g) } } GROUP BY ?g", "SELECT 'urn:h' AS g, count(*) AS k FROM region")


def _loaded(s: SparkSession, d: str) -> DataFrame:
    """Regions written as N-Triples, read back by LOAD into a graph of their own."""
    folder = new_folder(s, "ntriples")
    lines = s.read.parquet(f"{d}/region.parquet").select(F.format_string('<http://example.org/region/%s> <http://example.org/name> "%s" .', F.col("r_regionkey").cast("string"), "r_name"))
    lines.write.text(folder)
    db = Database(s)
    db.execute_sparql(f"LOAD <{folder}> INTO GRAPH <urn:loaded>")
    return db.execute_sparql(PREFIX + "SELECT ?x ?n WHERE { GRAPH <urn:loaded> { ?x ex:name ?n } }")


_add("sparql_load", _loaded, "SELECT 'http://example.org/region/' || r_regionkey AS x, r_name AS n FROM region")


def _triples_rolled_back(s: SparkSession, d: str) -> DataFrame:
    db = Database(s, triples=rdf.commerce(s, d))
    db.begin()
    db.execute_sparql("CLEAR ALL")
    db.rollback()
    return db.execute_sparql(PREFIX + "SELECT (COUNT(?x) AS ?n) WHERE { ?x a ex:Nation }")


_add("sparql_rollback", _triples_rolled_back, "SELECT count(*) AS n FROM nation")


def _saved(s: SparkSession, d: str) -> DataFrame:
    """Saved, opened, changed, saved to the same place and opened again."""
    folder = new_folder(s, "saved")
    g = tables.commerce(s, d)
    Database(s, replace(g, nodes=tuple(f for f in g.nodes if f.labels & {"Region", "Nation", "Customer"}), edges=tuple(g.edge_frames(["IN_REGION", "LIVES_IN"])))).save(folder)
    db = Database.open(s, folder)
    db.execute_cypher("MATCH (r:Region) WHERE r.r_regionkey = 0 DETACH DELETE r")
    db.save(folder)
    again = Database.open_in_memory(s, folder)
    return again.execute_cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, count(n) AS n")


_add("save_and_open", _saved, "SELECT r_name AS r, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey <> 0 GROUP BY 1")


def _dumped(s: SparkSession, d: str) -> DataFrame:
    folder = new_folder(s, "dumped")
    files.dump(PropertyGraph(s).add_nodes(s.read.parquet(f"{d}/customer.parquet").withColumn("id", F.col("c_custkey")), ["Customer"]), folder, "csv")
    g = files.load_nodes(PropertyGraph(s), f"{folder}/nodes/Customer-0", ["Customer"], format="csv")
    return Database(s, g).execute_cypher("MATCH (c:Customer) RETURN c.c_mktsegment AS seg, count(c) AS n, min(c.c_custkey) AS least")


_add("dump_and_load", _dumped, "SELECT c_mktsegment AS seg, count(*) AS n, min(c_custkey)::INT AS least FROM customer GROUP BY 1")


def _joined(kind: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        db = graph(s, d)
        left = db.execute_cypher("MATCH (c:Customer) WHERE c.c_acctbal > 5000 RETURN c.c_nationkey AS k, count(c) AS customers")
        right = db.execute_cypher("MATCH (x:Supplier) WHERE x.s_acctbal > 0 RETURN x.s_nationkey AS k, count(x) AS suppliers")
        return combine(left, right, ["k"], kind)

    return run


for _kind, _sql in (("right", "RIGHT"), ("full", "FULL")):
    _add(f"join_{_kind}", _joined(_kind), f"WITH c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 0 GROUP BY 1) SELECT coalesce(c.k, s.k) AS k, customers, suppliers FROM c {_sql} JOIN s ON c.k = s.k")


def _firsts(s: SparkSession, d: str) -> DataFrame:
    """First and last, where every row of a group has the same value."""
    nations = s.read.parquet(f"{d}/nation.parquet").join(s.read.parquet(f"{d}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.groupBy(F.col("n_regionkey").alias("k")).agg(*[aggregate(f, F.col("r_name"), None, False, []).alias(f) for f in ("first", "last")])


_add("agg_first_last", _firsts, "SELECT r_regionkey AS k, r_name AS first, r_name AS last FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")


def _range_source(s: SparkSession, d: str) -> DataFrame:
    """Sources that are no table: rows from Python, a range, and nothing."""
    g = PropertyGraph.of_rows(s, [(1, ["A"], {"x": 1}), (2, ["A", "B"], {"x": 2})], [(1, 2, "R", {"w": 3})]).add_nodes(s.range(10, 20), ["Number"])
    db = Database(s, g)
    return db.execute_cypher("MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n UNION ALL MATCH (n:Nothing) RETURN 'Nothing' AS label, count(n) AS n")


_add("sources", _range_source, "SELECT 'A' AS label, 2::BIGINT AS n UNION ALL SELECT 'Number', 10")


def _api(s: SparkSession, d: str) -> DataFrame:
    """Updates through calls instead of a language."""
    g = tables.commerce(s, d)
    db = Database(s, replace(g, nodes=tuple(g.node_frames(["Nation"])), edges=tuple(g.edge_frames(["IN_REGION"]))))
    a = db.create_node(["Probe"], {"name": "a"})
    b = db.create_node(["Probe"], {"name": "b"})
    e = db.create_edge(a, b, "TOUCHES", {"w": 1})
    db.set_edge_property(e, "w", 5)
    db.set_edge_property(e, "note", "x")
    had = (db.remove_edge_property(e, "note"), db.remove_edge_property(e, "note"))
    db.add_node_label(a, "Extra")
    return s.createDataFrame([(sorted(db.get_node_labels(a)), db.get_edge(e)["properties"], had[0], had[1], db.query("MATCH (p:Probe) WHERE p.name = $n RETURN count(p) AS n").param("n", "b").execute().first()[0])], "labels array<string>, props map<string,int>, first boolean, second boolean, n bigint").select(F.array_join("labels", ",").alias("labels"), F.col("props")["w"].alias("w"), F.size("props").alias("props"), "first", "second", "n")


_add("direct_updates", _api, "SELECT 'Extra,Probe' AS labels, 5 AS w, 1 AS props, TRUE AS first, FALSE AS second, 1::BIGINT AS n")

# -- algorithms --------------------------------------------------------------------------------------------------------

CO = "co AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"
BOTH = "n AS (SELECT src AS id FROM co UNION SELECT dst FROM co), e AS (SELECT src, dst FROM co UNION ALL SELECT dst, src FROM co), l AS (SELECT src, dst FROM e UNION ALL SELECT id, id FROM n)"
TRADES = "t AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"


def on_parts(name: str, run: Callable, sql: str | None) -> None:
    """On the graph of parts that share an order."""
    _add(name, lambda s, d: run(Algorithms(edges=tables.co_purchase(s, d))), sql and sql.replace("{CO}", CO).replace("{BOTH}", BOTH))


def tables_start(a: Algorithms) -> int:
    return a.edges.agg(F.min("src")).first()[0]


def ids_of(a: Algorithms, ids: list[int]) -> DataFrame:
    return a.edges.sparkSession.createDataFrame([(x,) for x in ids], "id bigint")


#: Rounds that SQL runs where the operator stops by itself; more than any of the tables needs.
ROUNDS = 60

on_parts("degree", lambda a: a.degree_centrality(), "WITH {CO}, e AS (SELECT src AS id, 1 AS o, 0 AS i FROM co UNION ALL SELECT dst, 0, 1 FROM co) SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS total FROM e GROUP BY 1")
on_parts("triangles", lambda a: a.triangles().agg(F.count(F.lit(1)).alias("n")), "WITH {CO} SELECT count(*) AS n FROM co x JOIN co y ON x.dst = y.src JOIN co z ON z.src = x.src AND z.dst = y.dst")
on_parts("triangle_list", lambda a: a.triangles(), "WITH {CO} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM co x JOIN co y ON x.dst = y.src JOIN co z ON z.src = x.src AND z.dst = y.dst")
on_parts("components", lambda a: a.connected_components(), f"WITH RECURSIVE {{CO}}, {{BOTH}}, r AS (SELECT id, id AS c, 0 AS k FROM n UNION ALL SELECT l.dst, min(r.c), r.k + 1 FROM r JOIN l ON l.src = r.id WHERE r.k < {ROUNDS} GROUP BY l.dst, r.k) SELECT id, c AS component FROM r WHERE k = {ROUNDS}")
on_parts("bfs_layers", lambda a: a.bfs(tables_start(a)), "WITH RECURSIVE {CO}, r AS (SELECT (SELECT min(src) FROM co) AS id, 0 AS depth UNION ALL SELECT DISTINCT co.dst, r.depth + 1 FROM r JOIN co ON co.src = r.id WHERE r.depth < 60) SELECT id, min(depth)::BIGINT AS depth FROM r GROUP BY 1")
on_parts("topo_layers", lambda a: a.topological_layers()[0], "WITH RECURSIVE {CO}, n AS (SELECT src AS id FROM co UNION SELECT dst FROM co), r AS (SELECT id, 0 AS layer FROM n UNION ALL SELECT DISTINCT co.dst, r.layer + 1 FROM r JOIN co ON co.src = r.id) SELECT id, max(layer)::BIGINT AS layer FROM r GROUP BY 1")
on_parts("kcore", lambda a: a.kcore(), f"WITH RECURSIVE {{CO}}, {{BOTH}}, r AS (SELECT src AS id, count(*) AS h, 0 AS k FROM e GROUP BY 1 UNION ALL SELECT id, max(least(v, place)), k + 1 FROM (SELECT e.dst AS id, r.h AS v, r.k, row_number() OVER (PARTITION BY e.dst ORDER BY r.h DESC) AS place FROM r JOIN e ON e.src = r.id WHERE r.k < {ROUNDS}) GROUP BY id, k) SELECT id, h AS core FROM r WHERE k = {ROUNDS}")
on_parts("label_propagation", lambda a: a.label_propagation(20), "WITH RECURSIVE {CO}, {BOTH}, r AS (SELECT id, id AS label, 0 AS k FROM n UNION ALL SELECT id, label, k + 1 FROM (SELECT l.dst AS id, r.label, r.k, row_number() OVER (PARTITION BY l.dst ORDER BY count(*) DESC, r.label) AS place FROM r JOIN l ON l.src = r.id WHERE r.k < 20 GROUP BY l.dst, r.label, r.k) WHERE place = 1) SELECT id, label FROM r WHERE k = 20")
on_parts("louvain", lambda a: a.louvain()[0], None)
on_parts("closeness", lambda a: a.closeness_centrality().select("id", F.round("score", 9).alias("score")), None)
on_parts("betweenness", lambda a: a.betweenness_centrality().select("id", F.round("score", 12).alias("score")), None)
on_parts("articulation_points", lambda a: a.cut_nodes(), None)
on_parts("bridges", lambda a: a.cut_edges(), None)
# the operator's own test of convergence: the first round in which no score moves by the tolerance
on_parts("pagerank", lambda a: a.pagerank().select("id", F.round("score", 9).alias("score")), "WITH RECURSIVE {CO}, n AS (SELECT src AS id FROM co UNION SELECT dst FROM co), c AS (SELECT count(*) AS n FROM n), o AS (SELECT src, count(*) AS k FROM co GROUP BY 1), a AS (SELECT co.src, co.dst, 1.0::DOUBLE / o.k AS share FROM co JOIN o USING (src) UNION ALL SELECT id, id, 0.0 FROM n), r AS (SELECT id, 1.0::DOUBLE / c.n AS score, 0.0::DOUBLE AS old, 0 AS k FROM n, c UNION ALL SELECT a.dst, 0.15 / max(c.n) + 0.85 * sum(r.score * a.share) + 0.85 * max(lost) / max(c.n), max(CASE WHEN a.src = a.dst THEN r.score END), r.k + 1 FROM (SELECT r.id, r.score, r.k, sum(CASE WHEN o.src IS NULL THEN r.score ELSE 0 END) OVER () AS lost FROM r LEFT JOIN o ON o.src = r.id WHERE r.k < 100) r JOIN a ON a.src = r.id, c GROUP BY a.dst, r.k), m AS (SELECT min(k) AS k FROM (SELECT k FROM r WHERE k > 0 GROUP BY k HAVING max(abs(score - old)) < 1e-6)) SELECT id, round(score, 9) AS score FROM r WHERE k = (SELECT k FROM m)")


def _louvain_facts(a: Algorithms) -> DataFrame:
    """What holds of every run: all nodes have a label, a label is its smallest member, and modularity is no worse than
    that of single nodes."""
    labels, q = a.louvain()
    own = labels.where("id = label").select("label")
    alone = a.modularity(a.nodes.select("id", F.col("id").alias("label")))
    facts = labels.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("k"), F.bool_and(F.col("label") <= F.col("id")).alias("smallest"))
    return facts.crossJoin(own.agg(F.count(F.lit(1)).alias("owners"))).select("n", (F.col("k") == F.col("owners")).alias("members"), "smallest", F.lit(q >= alone).alias("better"))


on_parts("louvain_facts", _louvain_facts, "WITH {CO} SELECT count(*) AS n, TRUE AS members, TRUE AS smallest, TRUE AS better FROM (SELECT src AS id FROM co UNION SELECT dst FROM co)")

# customers and suppliers, their nations, the nations' regions: a forest, where the answers have a closed form
GEO = "g AS (SELECT c_custkey::BIGINT + 2 * 1099511627776 AS src, c_nationkey::BIGINT + 1099511627776 AS dst FROM customer UNION ALL SELECT s_suppkey::BIGINT + 3 * 1099511627776, s_nationkey::BIGINT + 1099511627776 FROM supplier UNION ALL SELECT n_nationkey::BIGINT + 1099511627776, n_regionkey::BIGINT FROM nation), n AS (SELECT src AS id FROM g UNION SELECT dst FROM g)"


def on_geography(name: str, run: Callable, sql: str) -> None:
    _add(name, lambda s, d: run(Algorithms(edges=tables.commerce(s, d).scan_edges(["IN_REGION", "LIVES_IN", "BASED_IN"]))), sql.replace("{G}", GEO))


on_geography("closeness_forest", lambda a: a.closeness_centrality().select("id", F.round("score", 9).alias("score")), "WITH {G}, d AS (SELECT src AS id, 1 AS d FROM g UNION ALL SELECT x.src, 2 FROM g x JOIN g y ON x.dst = y.src) SELECT n.id, round(coalesce(count(d)::DOUBLE / sum(d), 0), 9) AS score FROM n LEFT JOIN d USING (id) GROUP BY 1")
on_geography("betweenness_forest", lambda a: a.betweenness_centrality(False), "WITH {G}, i AS (SELECT dst AS id, count(*) AS i FROM g GROUP BY 1), o AS (SELECT src AS id, count(*) AS o FROM g GROUP BY 1) SELECT n.id, coalesce(i.i * o.o, 0)::DOUBLE AS score FROM n LEFT JOIN i USING (id) LEFT JOIN o USING (id)")
on_geography("articulation_forest", lambda a: a.cut_nodes(), "WITH {G} SELECT id FROM (SELECT src AS id FROM g UNION ALL SELECT dst FROM g) GROUP BY 1 HAVING count(*) > 1")
on_geography("bridges_forest", lambda a: a.cut_edges(), "WITH {G} SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM g")
on_geography("dfs_order", lambda a: ids_of(a, a.dfs(7 + 2 * tables.SPAN)), "WITH {G} SELECT 7 + 2 * 1099511627776 AS id UNION ALL SELECT dst FROM g WHERE src = 7 + 2 * 1099511627776 UNION ALL SELECT y.dst FROM g x JOIN g y ON y.src = x.dst WHERE x.src = 7 + 2 * 1099511627776")
on_geography("graph_stats", lambda a: a.edges.sparkSession.createDataFrame([(a.nodes.count(), a.edges.count())], "n bigint, m bigint"), "WITH {G} SELECT (SELECT count(*) FROM n) AS n, count(*) AS m FROM g")


def _tree_edges(a: Algorithms) -> DataFrame:
    """Edges that a breadth-first walk from customer 7 goes along, told by a visitor."""
    found: list[tuple] = []
    a.visit(7 + 2 * tables.SPAN, lambda e: found.append((e.node, e.target)) if e.kind == "tree" else None)
    return a.edges.sparkSession.createDataFrame(found, "src bigint, dst bigint")


on_geography("visit_tree_edges", _tree_edges, "WITH {G} SELECT src, dst FROM g WHERE src = 7 + 2 * 1099511627776 UNION ALL SELECT y.src, y.dst FROM g x JOIN g y ON y.src = x.dst WHERE x.src = 7 + 2 * 1099511627776")


def on_trades(name: str, run: Callable, sql: str | None) -> None:
    _add(name, lambda s, d: run(Algorithms(edges=tables.trades(s, d))), sql and sql.replace("{T}", TRADES))


on_trades("sssp", lambda a: a.dijkstra(0, weight="weight").select("id", "distance"), "WITH RECURSIVE {T}, r AS (SELECT 0::BIGINT AS id, 0.0::DOUBLE AS d, 0 AS n UNION ALL SELECT dst, min(d + weight), n + 1 FROM r JOIN t ON t.src = r.id WHERE n < 6 GROUP BY dst, n) SELECT id, min(d) AS distance FROM r GROUP BY 1")
on_trades("bellman_ford", lambda a: a.bellman_ford(3, "weight")[0].select("id", "distance"), "WITH RECURSIVE {T}, r AS (SELECT 3::BIGINT AS id, 0.0::DOUBLE AS d, 0 AS n UNION ALL SELECT dst, min(d + weight), n + 1 FROM r JOIN t ON t.src = r.id WHERE n < 6 GROUP BY dst, n) SELECT id, min(d) AS distance FROM r GROUP BY 1")
on_trades("floyd_warshall", lambda a: a.floyd_warshall("weight"), "WITH RECURSIVE {T}, r AS (SELECT DISTINCT src, src AS dst, 0.0::DOUBLE AS d, 0 AS n FROM t UNION ALL SELECT r.src, t.dst, min(d + weight), n + 1 FROM r JOIN t ON t.src = r.dst WHERE n < 6 GROUP BY r.src, t.dst, n) SELECT src, dst, min(d) AS distance FROM r GROUP BY 1, 2")
# an edge is in the tree if no path of smaller edges joins its ends: the least largest place on any path between them is its own
FOREST = "p AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, min(weight) AS w FROM t WHERE src <> dst GROUP BY 1, 2), q AS (SELECT u, v, w, row_number() OVER (ORDER BY w, u, v) AS place FROM p), e AS (SELECT u AS src, v AS dst, place FROM q UNION ALL SELECT v, u, place FROM q), r AS (SELECT DISTINCT src AS s, src AS x, 0::BIGINT AS top, 0 AS k FROM e UNION ALL SELECT r.s, e.dst, min(greatest(r.top, e.place)), r.k + 1 FROM r JOIN e ON e.src = r.x WHERE r.k < 25 GROUP BY r.s, e.dst, r.k), b AS (SELECT s, x, min(top) AS top FROM r WHERE k > 0 GROUP BY 1, 2)"
on_trades("mst_weight", lambda a: a.kruskal("weight").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")), f"WITH RECURSIVE {{T}}, {FOREST} SELECT sum(w) AS weight, count(*) AS n FROM q JOIN b ON b.s = q.u AND b.x = q.v AND b.top = q.place")
on_trades("prim_weight", lambda a: a.edges.sparkSession.createDataFrame([(sum(w for _, _, w in a.prim("weight")),)], "weight double"), f"WITH RECURSIVE {{T}}, {FOREST} SELECT sum(w) AS weight FROM q JOIN b ON b.s = q.u AND b.x = q.v AND b.top = q.place")
# a flow as large as a cut is a largest flow: SQL gives the smaller of the cuts around the source and around the sink
on_trades("max_flow", lambda a: a.nodes.sparkSession.createDataFrame([(a.max_flow(0, 24, "weight")[0],)], "flow double"), "WITH {T} SELECT least((SELECT sum(weight) FROM t WHERE src = 0 AND dst <> 0), (SELECT sum(weight) FROM t WHERE dst = 24 AND src <> 24)) AS flow")
on_trades("astar_distance", lambda a: a.edges.sparkSession.createDataFrame([(a.astar(0, 24, None, "weight")[0], a.dijkstra_path(0, 24, "weight")[0])], "distance double, same double"), "WITH RECURSIVE {T}, r AS (SELECT 0::BIGINT AS id, 0.0::DOUBLE AS d, 0 AS n UNION ALL SELECT dst, min(d + weight), n + 1 FROM r JOIN t ON t.src = r.id WHERE n < 6 GROUP BY dst, n) SELECT min(d) AS distance, min(d) AS same FROM r WHERE id = 24")
on_trades("min_cost_flow", lambda a: a.nodes.sparkSession.createDataFrame([a.min_cost_max_flow(0, 24, "weight", "weight")], "flow double, cost double"), None)


def _scc(s: SparkSession, d: str) -> DataFrame:
    """Strong components of the trades above the mean weight, without trades of a nation with itself."""
    t = tables.trades(s, d)
    mean = t.agg(F.avg("weight")).first()[0]
    return Algorithms(edges=t.where((F.col("weight") > mean * 1.3) & (F.col("src") != F.col("dst")))).strongly_connected_components()


_add("scc", _scc, f"WITH RECURSIVE {TRADES}, e AS (SELECT src, dst FROM t WHERE weight > 1.3 * (SELECT avg(weight) FROM t) AND src <> dst), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1")
_add("user_components", lambda s, d: connected_components(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 97 + 1_000_000).alias("dst"))).groupBy("component").agg(F.count(F.lit(1)).alias("n")), "WITH RECURSIVE e AS (SELECT o_custkey AS a, o_orderkey % 97 + 1000000 AS b FROM orders), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT min(a) AS id FROM s UNION SELECT s.b FROM r JOIN s ON s.a = r.id) SELECT min(id)::BIGINT AS component, count(*) AS n FROM r")
