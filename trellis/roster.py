"""The driver's tables as a property graph, and one query per operator with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Engine
from .sources import delimited
from .sources.graph import PropertyGraph, slices, stored
from .sources.shared import work_dir
from .traversal import gt, traverse

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


_tables: dict[tuple, DataFrame] = {}


def _table(spark: SparkSession, path: str) -> DataFrame:
    """A table's schema is looked up once per application; its rows are read when a query runs."""
    key = spark.sparkContext.applicationId, path
    if key not in _tables:
        _tables[key] = spark.read.parquet(path)
    return _tables[key]


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Lazy: a query reads the tables that it needs, and just the columns that it needs."""
    t = lambda n: _table(spark, f"{sf_dir}/{n}.parquet")
    g = PropertyGraph(spark)
    for label, key in KEYS.items():
        g.add_vertices(label, t(label), key)
    g.add_vertices("event", t("events"), "event_id")
    line = t("lineitem")
    g.add_edges("placed", "customer", "orders", t("orders"), "o_custkey", "o_orderkey")
    g.add_edges("contains", "orders", "part", line, "l_orderkey", "l_partkey", ("l_quantity", "l_returnflag"))
    g.add_edges("shipped_by", "orders", "supplier", line, "l_orderkey", "l_suppkey")
    g.add_edges("supplies", "supplier", "part", line, "l_suppkey", "l_partkey")
    g.add_edges("lives_in", "customer", "nation", t("customer"), "c_custkey", "c_nationkey")
    g.add_edges("based_in", "supplier", "nation", t("supplier"), "s_suppkey", "s_nationkey")
    g.add_edges("part_of", "nation", "region", t("nation"), "n_nationkey", "n_regionkey")
    g.add_edges("did", "customer", "event", t("events"), "user_id", "event_id")
    g.add_stored_edges("co_bought", "part", "part", lambda: _co_bought(spark, line, sf_dir))
    return g


_stored: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def _co_bought(spark: SparkSession, line: DataFrame, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of parts in one order, the smaller key first; derived and stored once per application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stored:
        lines = line.select("l_orderkey", "l_partkey").repartition(slices(spark, line.count()), "l_orderkey")
        a, b = (lines.select(F.col("l_orderkey").alias(o), F.col("l_partkey").alias(p)) for o, p in (("o1", "__src"), ("o2", "__dst")))
        _stored[key] = stored(a.join(b, (F.col("o1") == F.col("o2")) & (F.col("__src") < F.col("__dst"))).select("__src", "__dst"), distinct=True)
    return _stored[key]


_CO = """co AS (SELECT DISTINCT a.l_partkey AS p1, b.l_partkey AS p2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey),
 cb AS (SELECT p1 AS s, p2 AS d FROM co UNION ALL SELECT p2, p1 FROM co)"""
_WALK2 = f"WITH {_CO}, w AS (SELECT d AS q FROM cb WHERE s = 7 UNION ALL SELECT y.d FROM cb x JOIN cb y ON x.d = y.s WHERE x.s = 7)"
_ONE = "OPTIONAL MATCH (c)-[:placed]->(o:orders) WHERE o.o_totalprice > 300000"

#: name -> (query, SQL or None)
CYPHER: dict[str, tuple[str, str | None]] = {
    "flagship": ("MATCH (c:customer)-[:placed]->(o:orders) WHERE o.o_totalprice > 100000 RETURN c.c_mktsegment AS seg, count(o) AS n", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY 1"),
    "scan_label": ("MATCH (n:nation) RETURN n.n_name AS name", "SELECT n_name AS name FROM nation"),
    "scan_all_count": ("MATCH (n) RETURN count(n) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) AS n"),
    "scan_label_property": ("MATCH (n) WHERE n.label = 'region' OR n.label = 'nation' RETURN n.label AS label, n.n_name AS name", "SELECT 'nation' AS label, n_name AS name FROM nation UNION ALL SELECT 'region', NULL FROM region"),
    "index_scan_range": ("MATCH (p:part) WHERE p.p_size > 3 AND p.p_size <= 10 RETURN p.p_partkey AS k, p.p_size AS size", "SELECT p_partkey AS k, p_size::BIGINT AS size FROM part WHERE p_size > 3 AND p_size <= 10"),
    "index_scan_union": ("MATCH (p:part) WHERE p.p_size > 3 AND p.p_size <= 10 OR p.p_size = 19 RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size > 3 AND p_size <= 10 OR p_size = 19"),
    "expand_out": ("MATCH (c:customer)-[:placed]->(o:orders) RETURN c.c_name AS name, o.o_orderkey AS k", "SELECT c_name AS name, o_orderkey AS k FROM customer JOIN orders ON c_custkey = o_custkey"),
    "expand_in": ("MATCH (o:orders)<-[:placed]-(c:customer) WHERE o.o_orderstatus = 'P' RETURN o.o_orderkey AS k, c.c_custkey AS c", "SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderstatus = 'P'"),
    "expand_both": ("MATCH (s:supplier {s_suppkey: 3})-[:supplies]-(p) RETURN p.p_partkey AS p, s.s_name AS s", "SELECT l_partkey AS p, s_name AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey = 3"),
    "expand_both_same_label": ("MATCH (p:part {p_partkey: 7})-[:co_bought]-(q) RETURN q.p_partkey AS q", f"WITH {_CO} SELECT d AS q FROM cb WHERE s = 7"),
    "expand_dst_label": ("MATCH (s:supplier)-->(x:nation) RETURN s.s_suppkey AS s, x.n_name AS n", "SELECT s_suppkey AS s, n_name AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "expand_untyped": ("MATCH (s:supplier)-->(x) WHERE s.s_suppkey < 3 RETURN s.s_suppkey AS s, x.label AS label, count(x) AS n", "SELECT s, label, count(*) AS n FROM (SELECT l_suppkey AS s, 'part' AS label FROM lineitem UNION ALL SELECT s_suppkey, 'nation' FROM supplier) WHERE s < 3 GROUP BY 1, 2"),
    "expand_degree": ("MATCH (o:orders)-[:contains]->() RETURN o.o_orderkey AS k, count(o) AS n", "SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1"),
    "expand_unknown_label": ("MATCH (x:nobody)-[:placed]->(o) RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE false"),
    "expand_into": ("MATCH (c:customer)-[:lives_in]->(n)<-[:based_in]-(s:supplier), (c)-[:placed]->(o)-[:shipped_by]->(s) RETURN c.c_custkey AS c, s.s_suppkey AS s, o.o_orderkey AS o", "SELECT c_custkey AS c, s_suppkey AS s, o_orderkey AS o FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_suppkey = s_suppkey"),
    "property_filter": ("MATCH (p:part {p_brand: 'Brand#2'}) WHERE p.p_retailprice > 950 RETURN p.p_name AS name, p.p_type AS type", "SELECT p_name AS name, p_type AS type FROM part WHERE p_brand = 'Brand#2' AND p_retailprice > 950"),
    "property_unknown": ("MATCH (n:nation) RETURN n.n_name AS name, n.nothing IS NULL AS none", "SELECT n_name AS name, true AS none FROM nation"),
    "edge_property_filter": ("MATCH (o:orders)-[l:contains {l_returnflag: 'R'}]->(p:part) WHERE l.l_quantity > 45 RETURN o.o_orderkey AS o, p.p_partkey AS p, l.l_quantity AS q", "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45"),
    "filter_3vl": ("MATCH (c:customer) WHERE NOT (c.nothing = 1) OR c.c_acctbal > 9000 OR NOT c.c_acctbal > -900 RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 9000 OR NOT c_acctbal > -900"),
    "filter_mixed_kinds": ("MATCH (p:part) WHERE p.p_size = 4.0 AND NOT (p.p_name = 4) RETURN p.p_partkey AS p", "SELECT p_partkey AS p FROM part WHERE p_size = 4"),
    "arith_exprs": ("MATCH (p:part) RETURN p.p_partkey AS k, (p.p_size * 3 - 50) / 7 AS q, (p.p_size - 30) % 7 AS r, -p.p_size AS m, p.p_size / 2.0 AS h, p.p_size / 0 AS z", "SELECT p_partkey AS k, (p_size * 3 - 50)::BIGINT // 7 AS q, (p_size - 30)::BIGINT % 7 AS r, -p_size::BIGINT AS m, p_size / 2.0::DOUBLE AS h, NULL::BIGINT AS z FROM part"),
    "string_concat": ("MATCH (n:nation) RETURN n.n_name + '!' AS s, n.n_name + 1 IS NULL AS none", "SELECT n_name || '!' AS s, true AS none FROM nation"),
    "chained_cmp": ("MATCH (p:part) WHERE 5 < p.p_size < 9 RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE 5 < p_size AND p_size < 9"),
    "null_tests": ("MATCH (n) WHERE n.n_name IS NOT NULL OR n.r_name IS NOT NULL RETURN n.n_name AS a, n.r_name AS b", "SELECT n_name AS a, NULL AS b FROM nation UNION ALL SELECT NULL, r_name FROM region"),
    "project_dup": ("MATCH (c:customer)-[:lives_in]->(n) RETURN n.n_name AS n, c.c_mktsegment AS s", "SELECT n_name AS n, c_mktsegment AS s FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "distinct": ("MATCH (c:customer) RETURN DISTINCT c.c_mktsegment AS s", "SELECT DISTINCT c_mktsegment AS s FROM customer"),
    "order_by": ("MATCH (s:supplier) RETURN s.s_suppkey AS s ORDER BY s.s_acctbal DESC, s.s_suppkey", "SELECT s_suppkey AS s FROM supplier"),
    "order_limit": ("MATCH (c:customer) RETURN c.c_custkey AS c, c.c_acctbal AS b ORDER BY b DESC, c LIMIT 10", "SELECT c_custkey AS c, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10"),
    "order_skip_limit": ("MATCH (c:customer) RETURN c.c_custkey AS c ORDER BY c.c_acctbal, c.c_custkey SKIP 5 LIMIT 10", "SELECT c_custkey AS c FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 5"),
    "distinct_order_limit": ("MATCH (p:part) RETURN DISTINCT p.p_brand AS b, p.p_type AS t ORDER BY b DESC, t LIMIT 7", "SELECT DISTINCT p_brand AS b, p_type AS t FROM part ORDER BY b DESC, t LIMIT 7"),
    "limit_only": ("MATCH (c:customer) WITH c LIMIT 5 RETURN count(c) AS n, count(DISTINCT c) AS d", "SELECT count(*) AS n, count(*) AS d FROM (SELECT c_custkey FROM customer LIMIT 5)"),
    "return_star": ("MATCH (n:nation)-[:part_of]->(r {r_name: 'ASIA'}) WITH n.n_name AS name, r.r_regionkey AS r RETURN *", "SELECT n_name AS name, r_regionkey::BIGINT AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "return_constant": ("RETURN 1 + 1 AS two, 'a' AS a", "SELECT 2::BIGINT AS two, 'a' AS a"),
    "limit_zero": ("MATCH (c:customer) RETURN c.c_custkey AS c LIMIT 0", "SELECT c_custkey AS c FROM customer LIMIT 0"),
    "agg_sum": ("MATCH (p:part) RETURN p.p_brand AS b, sum(p.p_size) AS s", "SELECT p_brand AS b, sum(p_size)::BIGINT AS s FROM part GROUP BY 1"),
    "agg_avg": ("MATCH (p:part) RETURN p.p_brand AS b, avg(p.p_size) AS a", "SELECT p_brand AS b, avg(p_size) AS a FROM part GROUP BY 1"),
    "agg_count": ("MATCH (o:orders)-[:contains]->(p:part) RETURN p.p_brand AS b, count(p) AS n, count(*) AS m", "SELECT p_brand AS b, count(*) AS n, count(*) AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "agg_min_max": ("MATCH (o:orders) RETURN o.o_orderpriority AS p, min(o.o_totalprice) AS lo, max(o.o_totalprice) AS hi, max(o.o_orderstatus) AS s", "SELECT o_orderpriority AS p, min(o_totalprice) AS lo, max(o_totalprice) AS hi, max(o_orderstatus) AS s FROM orders GROUP BY 1"),
    "agg_distinct": ("MATCH (p:part) RETURN p.p_brand AS b, count(DISTINCT p.p_size) AS n, sum(DISTINCT p.p_size) AS s, avg(DISTINCT p.p_size) AS a", "SELECT p_brand AS b, count(DISTINCT p_size) AS n, sum(DISTINCT p_size)::BIGINT AS s, avg(DISTINCT p_size) AS a FROM part GROUP BY 1"),
    "agg_expr": ("MATCH (p:part) RETURN p.p_type AS t, sum(p.p_size) / count(p) AS q, max(p.p_size) - min(p.p_size) AS w", "SELECT p_type AS t, sum(p_size)::BIGINT // count(*) AS q, (max(p_size) - min(p_size))::BIGINT AS w FROM part GROUP BY 1"),
    "agg_order_limit": ("MATCH (c:customer)-[:placed]->(o) RETURN c.c_custkey AS c, count(o) AS n ORDER BY n DESC, c LIMIT 10", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, c LIMIT 10"),
    "agg_global": ("MATCH (e:event) WHERE e.event_type = 'no such' RETURN count(e) AS n, max(e.value) AS m", "SELECT 0::BIGINT AS n, NULL::DOUBLE AS m"),
    "with_chain": ("MATCH (c:customer)-[:placed]->(o) WITH c, count(o) AS n MATCH (c)-[:lives_in]->(x) RETURN x.n_name AS nation, sum(n) AS orders, max(n) AS most", "SELECT n_name AS nation, sum(k)::BIGINT AS orders, max(k) AS most FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1"),
    "with_where": ("MATCH (c:customer)-[:placed]->(o) WITH c, count(o) AS n WHERE n > 15 RETURN c.c_name AS name, n AS n", "SELECT c_name AS name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 15"),
    "with_distinct": ("MATCH (p:part {p_partkey: 7})-[:co_bought]-(q) WITH DISTINCT q MATCH (q)<-[:contains]-(o) RETURN q.p_partkey AS q, count(DISTINCT o) AS n", f"WITH {_CO} SELECT d AS q, count(DISTINCT l_orderkey) AS n FROM (SELECT DISTINCT d FROM cb WHERE s = 7) JOIN lineitem ON l_partkey = d GROUP BY 1"),
    "with_rename_order_limit": ("MATCH (s:supplier) WITH s AS t ORDER BY s.s_acctbal DESC, s.s_suppkey LIMIT 5 MATCH (t)-[:based_in]->(n) RETURN t.s_name AS s, n.n_name AS n", "SELECT s_name AS s, n_name AS n FROM (SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5) JOIN nation ON s_nationkey = n_nationkey"),
    "return_node": ("MATCH (n:nation)-[:part_of]->(r) RETURN n AS n, r AS r", "SELECT n_nationkey::BIGINT AS n, n_regionkey::BIGINT AS r FROM nation"),
    "pattern_and": ("MATCH (c:customer) WHERE (c)-[:did]->() AND (c)-[:lives_in]->(:nation {n_nationkey: 3}) RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_nationkey = 3 AND EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)"),
    "pattern_or": ("MATCH (c:customer) WHERE (c)-[:did]->() OR (c)-[:lives_in]->(:nation {n_nationkey: 3}) RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_nationkey = 3 OR EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)"),
    "pattern_not": ("MATCH (c:customer) WHERE NOT (c)-[:did]->() RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)"),
    "pattern_or_prop": ("MATCH (c:customer)-[:placed]->(o:orders) WHERE o.o_totalprice < 1000 OR (c)-[:did]->() RETURN o.o_orderkey AS o", "SELECT o_orderkey AS o FROM orders WHERE o_totalprice < 1000 OR EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey)"),
    "pattern_both_ends": ("MATCH (p:part {p_partkey: 7})-[:co_bought]-(q)-[:co_bought]-(r) WHERE (p)-[:co_bought]-(r) RETURN q.p_partkey AS q, r.p_partkey AS r", f"WITH {_CO} SELECT x.d AS q, y.d AS r FROM cb x JOIN cb y ON x.d = y.s WHERE x.s = 7 AND EXISTS (SELECT 1 FROM cb z WHERE z.s = 7 AND z.d = y.d)"),
    "optional_match": ("MATCH (n:nation) OPTIONAL MATCH (n)<-[:based_in]-(s:supplier) RETURN n.n_name AS n, s.s_name AS s", "SELECT n_name AS n, s_name AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey"),
    "optional_match_where": (f"MATCH (c:customer) {_ONE} RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000"),
    "optional_outer_where": ("MATCH (c:customer)-[:lives_in]->(n) OPTIONAL MATCH (c)-[:placed]->(o) WHERE o.o_totalprice > c.c_acctbal * 40 RETURN c.c_custkey AS c, n.n_name AS n, count(o) AS k", "SELECT c_custkey AS c, n_name AS n, count(o_orderkey) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40 GROUP BY 1, 2"),
    "optional_count": (f"MATCH (c:customer) {_ONE} RETURN c.c_custkey AS c, count(o) AS n", "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1"),
    "optional_then_expand": (f"MATCH (c:customer) {_ONE} MATCH (o)-[:contains]->(p) RETURN c.c_custkey AS c, p.p_partkey AS p", "SELECT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 300000"),
    "varlen_1_2": ("MATCH (p:part {p_partkey: 7})-[:co_bought*1..2]-(q) RETURN q.p_partkey AS q, count(q) AS n", f"{_WALK2} SELECT q, count(*) AS n FROM w GROUP BY 1"),
    "varlen_2_2": ("MATCH (p:part {p_partkey: 7})-[:co_bought*2..2]-(q) WHERE q.p_size < 10 RETURN q.p_partkey AS q", f"WITH {_CO} SELECT y.d AS q FROM cb x JOIN cb y ON x.d = y.s JOIN part ON p_partkey = y.d WHERE x.s = 7 AND p_size < 10"),
    "varlen_0_1": ("MATCH (p:part {p_partkey: 7})-[:co_bought*0..1]->(q) RETURN q.p_partkey AS q", f"WITH {_CO} SELECT p2 AS q FROM co WHERE p1 = 7 UNION ALL SELECT 7"),
    "varlen_unbounded": ("MATCH (n:nation {n_nationkey: 1})-[:part_of*]->(x) RETURN x.r_name AS r", "SELECT r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 1"),
    "varlen_distinct": ("MATCH (p:part {p_partkey: 7})-[:co_bought*1..2]-(q) RETURN DISTINCT q.p_partkey AS q", f"{_WALK2} SELECT DISTINCT q FROM w"),
    # the operators above over whole tables, from all start vertices
    "expand_both_all": ("MATCH (s:supplier)-[:supplies]-(p) RETURN p.p_partkey AS p, s.s_name AS s", "SELECT l_partkey AS p, s_name AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    "expand_both_same_label_all": ("MATCH (p:part)-[:co_bought]-(q) RETURN p.p_partkey AS p, q.p_partkey AS q", f"WITH {_CO} SELECT s AS p, d AS q FROM cb"),
    "expand_untyped_all": ("MATCH (s:supplier)-->(x) RETURN s.s_suppkey AS s, x.label AS label, count(x) AS n", "SELECT s, label, count(*) AS n FROM (SELECT l_suppkey AS s, 'part' AS label FROM lineitem UNION ALL SELECT s_suppkey, 'nation' FROM supplier) GROUP BY 1, 2"),
    "with_distinct_all": ("MATCH (p:part)-[:co_bought]-(q) WITH DISTINCT q MATCH (q)<-[:contains]-(o) RETURN q.p_partkey AS q, count(DISTINCT o) AS n", f"WITH {_CO} SELECT d AS q, count(DISTINCT l_orderkey) AS n FROM (SELECT DISTINCT d FROM cb) JOIN lineitem ON l_partkey = d GROUP BY 1"),
    "cartesian_all": ("MATCH (r:region), (n:nation) RETURN r.r_name AS r, n.n_name AS n", "SELECT r_name AS r, n_name AS n FROM region, nation"),
    "varlen_0_1_all": ("MATCH (p:part)-[:co_bought*0..1]->(q) RETURN p.p_partkey AS p, q.p_partkey AS q", f"WITH {_CO} SELECT p1 AS p, p2 AS q FROM co UNION ALL SELECT p_partkey, p_partkey FROM part"),
    "varlen_1_2_all": ("MATCH (p:part)-[:co_bought*1..2]-(q) RETURN q.p_partkey AS q, count(q) AS n", f"WITH {_CO}, w AS (SELECT d AS q FROM cb UNION ALL SELECT y.d FROM cb x JOIN cb y ON x.d = y.s) SELECT q, count(*) AS n FROM w GROUP BY 1"),
    "multi_path": ("MATCH (c:customer)-[:placed]->(o)-[:contains]->(p), (c)-[:lives_in]->(n)-[:part_of]->(r) WHERE p.p_size = 5 RETURN r.r_name AS r, count(o) AS n", "SELECT r_name AS r, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE p_size = 5 GROUP BY 1"),
    "consecutive_match": ("MATCH (s:supplier)-[:based_in]->(n) MATCH (n)-[:part_of]->(r {r_name: 'ASIA'}) RETURN s.s_name AS s, n.n_name AS n", "SELECT s_name AS s, n_name AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "cartesian": ("MATCH (r:region), (n:nation) WHERE n.n_nationkey < 3 RETURN r.r_name AS r, n.n_name AS n", "SELECT r_name AS r, n_name AS n FROM region, nation WHERE n_nationkey < 3"),
    "non_equi": ("MATCH (n:nation)-[:part_of]->(r)<-[:part_of]-(m:nation) WHERE n.n_nationkey < m.n_nationkey RETURN n.n_name AS a, m.n_name AS b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "self_conflict": ("MATCH (x:nation)-[:part_of]->(x) RETURN x.n_name AS n", "SELECT n_name AS n FROM nation WHERE false"),
    # the shapes of the reference workload: part for product, orders for review, customer for user
    "bench_ac1": ("MATCH (p:part {p_partkey: 7})-[:co_bought*1..2]-(q:part) WHERE q.p_type = 'ECONOMY' RETURN DISTINCT q.p_partkey AS k, q.p_brand AS b, q.p_name AS name, q.p_retailprice AS price ORDER BY q.p_retailprice, q.p_partkey LIMIT 20", f"{_WALK2} SELECT DISTINCT q AS k, p_brand AS b, p_name AS name, p_retailprice AS price FROM w JOIN part ON p_partkey = q WHERE p_type = 'ECONOMY' ORDER BY price, k LIMIT 20"),
    "bench_ac2": ("MATCH (:part {p_partkey: 7})-[:co_bought]->(p:part)<-[:contains]-(r:orders) WHERE r.o_totalprice < 200000 RETURN p.p_partkey AS p, p.p_name AS name, p.p_brand AS brand, r.o_orderkey AS r, r.o_totalprice AS price ORDER BY r.o_totalprice DESC, r.o_orderkey, p.p_partkey LIMIT 20", f"WITH {_CO} SELECT p_partkey AS p, p_name AS name, p_brand AS brand, o_orderkey AS r, o_totalprice AS price FROM co JOIN part ON p_partkey = p2 JOIN lineitem ON l_partkey = p2 JOIN orders ON o_orderkey = l_orderkey WHERE p1 = 7 AND o_totalprice < 200000 ORDER BY o_totalprice DESC, o_orderkey, p_partkey LIMIT 20"),
    "bench_ac3": ("MATCH (n:part {p_partkey: 7})-[:co_bought*1..2]->(m:part) WITH DISTINCT m MATCH (m)<-[:contains]-(r:orders) WHERE (r.o_totalprice > 50000 AND r.o_totalprice < 300000) AND (r.o_orderstatus = 'P' OR r.o_orderstatus = 'F') RETURN m.p_partkey AS m, m.p_name AS name, m.p_brand AS brand, r.o_orderkey AS r ORDER BY m.p_partkey, r.o_orderkey LIMIT 20", f"WITH {_CO}, w AS (SELECT p2 AS m FROM co WHERE p1 = 7 UNION SELECT y.p2 FROM co x JOIN co y ON x.p2 = y.p1 WHERE x.p1 = 7) SELECT m, p_name AS name, p_brand AS brand, o_orderkey AS r FROM w JOIN part ON p_partkey = m JOIN lineitem ON l_partkey = m JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > 50000 AND o_totalprice < 300000 AND o_orderstatus IN ('P', 'F') ORDER BY m, r LIMIT 20"),
    "bench_ac4": ("MATCH (u:customer {c_custkey: 5})-[:placed]->(r:orders)-[:contains]-(p:part)-[:co_bought*1..2]-(m:part) WHERE r.o_totalprice > 150000 RETURN m.p_partkey AS m, m.p_name AS name, m.p_brand AS brand, r.o_totalprice AS price ORDER BY price DESC, m LIMIT 20", f"WITH {_CO}, f AS (SELECT l_partkey AS p, o_totalprice AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 5 AND o_totalprice > 150000), w AS (SELECT d AS m, price FROM f JOIN cb ON s = p UNION ALL SELECT y.d, price FROM f JOIN cb x ON x.s = p JOIN cb y ON x.d = y.s) SELECT m, p_name AS name, p_brand AS brand, price FROM w JOIN part ON p_partkey = m ORDER BY price DESC, m LIMIT 20"),
    "bench_ac5": ("MATCH (:part {p_partkey: 7})-[:co_bought*1..2]-(p:part) WITH DISTINCT p MATCH (p)<-[:contains]-(g:orders) WHERE g.o_totalprice >= 250000 WITH DISTINCT p MATCH (p)<-[:contains]-(b:orders) WHERE b.o_totalprice <= 50000 RETURN p.p_brand AS brand, count(DISTINCT b) AS n ORDER BY p.p_brand LIMIT 20", f"{_WALK2}, g AS (SELECT DISTINCT q FROM w JOIN lineitem ON l_partkey = q JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice >= 250000) SELECT p_brand AS brand, count(DISTINCT o_orderkey) AS n FROM g JOIN part ON p_partkey = q JOIN lineitem ON l_partkey = q JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice <= 50000 GROUP BY 1 ORDER BY 1 LIMIT 20"),
    "bench_ac6": ("MATCH (u:customer {c_custkey: 5})-[:placed]->(r:orders)-[:contains]->(p:part)-[:co_bought*1..2]-(rec:part) WHERE r.o_totalprice > 150000 AND (p)-[:co_bought]->(rec) RETURN p.p_name AS name, rec.p_partkey AS rec, rec.p_brand AS brand, p.p_partkey AS p ORDER BY p.p_partkey, rec.p_partkey LIMIT 20", f"WITH {_CO}, f AS (SELECT l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 5 AND o_totalprice > 150000), w AS (SELECT p, d AS m FROM f JOIN cb ON s = p UNION ALL SELECT p, y.d FROM f JOIN cb x ON x.s = p JOIN cb y ON x.d = y.s) SELECT a.p_name AS name, m AS rec, b.p_brand AS brand, p FROM w JOIN part a ON a.p_partkey = p JOIN part b ON b.p_partkey = m WHERE EXISTS (SELECT 1 FROM co WHERE p1 = p AND p2 = m) ORDER BY p, m LIMIT 20"),
    "bench_ac7": ("MATCH (u:customer {c_custkey: 5})-[:placed]->(r:orders)-[:contains]->(p:part)<-[:contains]-(r2:orders)<-[:placed]-(u2:customer) RETURN u2.c_custkey AS u, p.p_name AS name, p.p_brand AS brand ORDER BY u2.c_custkey, p.p_partkey LIMIT 20", "SELECT z.o_custkey AS u, p_name AS name, p_brand AS brand FROM orders a JOIN lineitem x ON x.l_orderkey = a.o_orderkey JOIN lineitem y ON x.l_partkey = y.l_partkey JOIN orders z ON z.o_orderkey = y.l_orderkey JOIN part ON p_partkey = x.l_partkey WHERE a.o_custkey = 5 ORDER BY u, p_partkey LIMIT 20"),
    "bench_as1": ("MATCH (r:orders {o_orderkey: 11})-[:contains]->(p:part) RETURN r.o_totalprice AS price, r.o_orderstatus AS status, p.p_partkey AS p", "SELECT o_totalprice AS price, o_orderstatus AS status, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 11"),
    "bench_as2": ("MATCH (p:part {p_partkey: 7})-[:co_bought]-(:part)<-[:contains]-(r:orders)<-[:placed]-(u:customer) RETURN r.o_orderkey AS r, r.o_totalprice AS price, u.c_custkey AS u", f"WITH {_CO} SELECT o_orderkey AS r, o_totalprice AS price, o_custkey AS u FROM cb JOIN lineitem ON l_partkey = d JOIN orders ON o_orderkey = l_orderkey WHERE s = 7"),
    "bench_as3": ("MATCH (n:part {p_partkey: 7})-[:co_bought]->(m:part) RETURN m.p_partkey AS m, m.p_name AS name, m.p_brand AS brand ORDER BY m.p_partkey", f"WITH {_CO} SELECT p2 AS m, p_name AS name, p_brand AS brand FROM co JOIN part ON p_partkey = p2 WHERE p1 = 7"),
    "bench_as4": ("MATCH (r:orders {o_orderkey: 11}) RETURN r.o_totalprice AS price, r.o_orderstatus AS status", "SELECT o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderkey = 11"),
    "bench_as5": ("MATCH (r:orders {o_orderkey: 11})-[:contains]->(p:part) RETURN p.p_partkey AS p, p.p_name AS name, p.p_brand AS brand", "SELECT p_partkey AS p, p_name AS name, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = 11"),
}


def _cypher(text: str, **kw):
    return lambda spark, sf_dir: Engine(graph(spark, sf_dir), **kw).run(text)


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(graph(spark, sf_dir))
    e.run("CREATE INDEX ON :part(p_size)")
    return e.run("MATCH (p:part) WHERE p.p_size >= 20 AND p.p_size < 25 RETURN p.p_partkey AS k, p.p_size AS size")


def _degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return _row(spark, ("p40", "p60", "p99"), g.histogram(g.degrees("customer", "did"), "degree", (40, 60, 99), exact=True))


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return _row(spark, ("p25", "p50", "p75"), g.histogram(g.vertices["part"], "p_size", (25, 50, 75), exact=True))


def _row(spark: SparkSession, names, values) -> DataFrame:
    return spark.createDataFrame([tuple(map(float, values))], ", ".join(f"{n} double" for n in names))


def _index_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(graph(spark, sf_dir))
    for text in ("CREATE INDEX ON :part(p_size)", "DROP INDEX ON :part(p_size)"):
        e.run(text)
    return e.run("MATCH (p:part) WHERE p.p_size = 19 RETURN p.p_partkey AS k")


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as delimited text, two groups of files with one label, and back as a graph."""
    at = work_dir(spark, "delimited")
    n, r = _table(spark, f"{sf_dir}/nation.parquet"), _table(spark, f"{sf_dir}/region.parquet")
    for k in (0, 1):
        delimited.dump(n.filter(n.n_nationkey % 2 == k).select(n.n_nationkey.alias("n_nationkey:id"), n.n_name.alias("n_name:string")), f"{at}/nation{k}")
    delimited.dump(r.select(r.r_regionkey.alias("r_regionkey:id"), r.r_name.alias("r_name:string")), f"{at}/region")
    delimited.dump(n.select(n.n_nationkey.alias(":start_id"), n.n_regionkey.alias(":end_id")), f"{at}/part_of")
    g = delimited.load(spark, [("nation", [f"{at}/nation0"]), ("nation", [f"{at}/nation1"]), ("region", [f"{at}/region"])], [("part_of", [f"{at}/part_of"])], {"part_of": ("nation", "region")})
    return Engine(g).run("MATCH (n:nation)-[:part_of]->(r:region) RETURN n.n_name AS nation, r.r_name AS region")


def _params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(graph(spark, sf_dir)).run("MATCH (o:orders {o_orderkey: $id})-[:contains]->(p) WHERE p.p_size > $least RETURN p.p_partkey AS p", {"id": 11, "least": 3})


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse(graph(spark, sf_dir)).V("customer").out("placed").has("o_totalprice", gt(100000)).count().to_df()


def _later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of any length, from all orders, along the chain of each customer's orders."""
    g, o = graph(spark, sf_dir), _table(spark, f"{sf_dir}/orders.parquet")
    then = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    g.add_edges("followed_by", "orders", "orders", o.select("o_orderkey", then.alias("then")).filter("then IS NOT NULL"), "o_orderkey", "then")
    return Engine(g).run("MATCH (a:orders)-[:followed_by*]->(b) RETURN a.o_orderkey AS a, count(b) AS n")


OTHER = {
    "varlen_unbounded_all": (_later, "SELECT a.o_orderkey AS a, count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey > a.o_orderkey GROUP BY 1"),
    "expand_into_exists": (_cypher("MATCH (s:supplier)-[:supplies]->(p:part), (s)-[:supplies]->(p) RETURN count(p) AS n", into="exists"), "SELECT count(*) AS n FROM lineitem"),
    "index_ddl": (_indexed, "SELECT p_partkey AS k, p_size::BIGINT AS size FROM part WHERE p_size >= 20 AND p_size < 25"),
    "degree_histogram": (_degrees, "SELECT quantile_cont(n, 0.4) AS p40, quantile_cont(n, 0.6) AS p60, quantile_cont(n, 0.99) AS p99 FROM (SELECT c_custkey, count(event_id) AS n FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1)"),
    "property_histogram": (_prices, "SELECT quantile_cont(p_size, 0.25) AS p25, quantile_cont(p_size, 0.5) AS p50, quantile_cont(p_size, 0.75) AS p75 FROM part"),
    "index_dropped": (_index_dropped, "SELECT p_partkey AS k FROM part WHERE p_size = 19"),
    "load_delimited": (_loaded, "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "parameters": (_params, "SELECT p_partkey AS p FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = 11 AND p_size > 3"),
    "traversal_steps": (_steps, "SELECT count(*) AS count FROM orders WHERE o_totalprice > 100000"),
}

QUERIES = {**{n: _cypher(q) for n, (q, _) in CYPHER.items()}, **{n: f for n, (f, _) in OTHER.items()}}
SQL = {**{n: s for n, (_, s) in CYPHER.items() if s}, **{n: s for n, (_, s) in OTHER.items()}}
