"""Queries over the driver's tables, by name: Cypher on the sales graph, with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.mapping import sales_graph
from . import more, writes

FLAGSHIP = """
    MATCH (c:Customer {c_mktsegment: 'BUILDING'})-[:PLACED]->(:Order)-[l:CONTAINS]->(p:Part)
    RETURN p.p_brand AS brand, count(*) AS n, round(sum(l.l_extendedprice) * 100) / 100 AS rev ORDER BY rev DESC, brand LIMIT 10
"""

#: name: (Cypher, SQL)
CYPHER: dict[str, tuple[str, str]] = {
    "flagship": (
        FLAGSHIP,
        """SELECT p_brand AS brand, count(*) AS n, round(sum(l_extendedprice) * 100) / 100 AS rev FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
           JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'BUILDING' GROUP BY p_brand ORDER BY rev DESC, brand LIMIT 10""",
    ),
    "node_scan": ("MATCH (n) RETURN count(*) AS n, count(n.c_name) AS customers", """SELECT CAST((SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part)
           + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM events) + (SELECT count(*) FROM conversations) AS BIGINT) AS n, (SELECT count(*) FROM customer) AS customers"""),
    "label_scan": ("MATCH (n:Nation) RETURN n.n_name AS name, n.n_nationkey AS k", "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS k FROM nation"),
    "multi_label": ("MATCH (n:Party) RETURN n:Customer AS customer, count(*) AS n", "SELECT true AS customer, count(*) AS n FROM customer UNION ALL SELECT false, count(*) FROM supplier"),
    "index_seek_filter": ("MATCH (p:Part {p_partkey: 77}) RETURN p.p_name AS name, p.p_size AS size", "SELECT p_name AS name, CAST(p_size AS BIGINT) AS size FROM part WHERE p_partkey = 77"),
    "expand_out": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 RETURN c.c_name AS name, o.o_orderkey AS k", "SELECT c_name AS name, o_orderkey AS k FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000"),
    "expand_in": ("MATCH (n:Nation)<-[:BASED_IN]-(s:Supplier) RETURN n.n_name AS nation, count(*) AS suppliers", "SELECT n_name AS nation, count(*) AS suppliers FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name"),
    "expand_undirected": (
        "MATCH (t:Turn {turn: 1})-[:REPLY]-(u) RETURN u.turn AS turn, u.role AS role, count(*) AS n",
        """SELECT u.turn, u.role, count(*) AS n FROM conversations t JOIN conversations u ON t.conv_id = u.conv_id AND abs(t.turn - u.turn) = 1 WHERE t.turn = 1 GROUP BY u.turn, u.role""",
    ),
    "expand_type_alternation": (
        "MATCH (x)-[:LIVES_IN|BASED_IN]->(n:Nation) RETURN n.n_name AS nation, count(*) AS parties",
        "SELECT n_name AS nation, count(*) AS parties FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON n_nationkey = k GROUP BY n_name",
    ),
    "expand_multi_hop": (
        "MATCH (r:Region)<-[:IN_REGION]-(:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.r_name AS region, count(*) AS orders, count(DISTINCT c) AS customers",
        "SELECT r_name AS region, count(*) AS orders, count(DISTINCT c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name",
    ),
    "expand_cyclic": (
        "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)<-[:BASED_IN]-(s:Supplier), (c)-[:PLACED]->(:Order)-[:CONTAINS]->(p:Part)<-[:SHIPPED]-(s) RETURN n.n_name AS nation, count(*) AS n",
        """SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem a ON a.l_orderkey = o_orderkey
           JOIN lineitem b ON b.l_partkey = a.l_partkey AND b.l_suppkey = s_suppkey GROUP BY n_name""",
    ),
    "parallel_edges": (
        "MATCH (o:Order)-[l:CONTAINS]->(p:Part) WITH o, p, count(l) AS n WHERE n > 1 RETURN o.o_orderkey AS o, p.p_partkey AS p, n",
        "SELECT l_orderkey AS o, l_partkey AS p, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    "self_loop": ("MATCH (n)-[r:NEXT]->(n) RETURN count(r) AS n", "SELECT CAST(0 AS BIGINT) AS n"),
    "unique_relationships": (
        "MATCH (a:Order)-[x:CONTAINS]->(p:Part)<-[y:CONTAINS]-(b:Order) RETURN p.p_partkey AS p, count(*) AS n",
        "SELECT a.l_partkey AS p, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND NOT (a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber) GROUP BY 1",
    ),
    "varlen_fixed": ("MATCH (a:Turn)-[:REPLY*2]->(b:Turn) RETURN a.conv_id AS c, a.turn AS a, b.turn AS b", "SELECT a.conv_id AS c, a.turn AS a, b.turn AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2"),
    "varlen_range": (
        "MATCH (a:Turn)-[:REPLY*1..3]->(b:Turn) RETURN b.turn - a.turn AS hops, count(*) AS n",
        "SELECT b.turn - a.turn AS hops, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn + 1 AND a.turn + 3 GROUP BY 1",
    ),
    "varlen_zero": (
        "MATCH (a:Turn {turn: 0})-[:REPLY*0..2]->(b:Turn) RETURN b.turn AS turn, count(*) AS n",
        "SELECT b.turn, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <= 2 WHERE a.turn = 0 GROUP BY 1",
    ),
    "varlen_unbounded": (
        "MATCH (a:Turn {turn: 0})-[:REPLY*]->(b:Turn) RETURN b.turn AS turn, count(*) AS n",
        """WITH RECURSIVE w AS (SELECT conv_id, turn FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn + 1)
           SELECT turn, count(*) AS n FROM w WHERE turn > 0 GROUP BY 1""",
    ),
    "varlen_incoming": (
        "MATCH (b:Turn {turn: 3})<-[:REPLY*1..2]-(a) RETURN a.turn AS turn, count(*) AS n",
        "SELECT a.turn, count(*) AS n FROM conversations b JOIN conversations a ON a.conv_id = b.conv_id AND a.turn BETWEEN 1 AND 2 WHERE b.turn = 3 GROUP BY 1",
    ),
    "varlen_rel_props": (
        "MATCH (s:Supplier)-[:SHIPPED*1..2 {l_linenumber: 1}]-(x) RETURN x:Part AS part, count(*) AS n",
        "WITH s AS (SELECT l_suppkey AS s, l_partkey AS p, l_orderkey AS o FROM lineitem WHERE l_linenumber = 1) SELECT true AS part, count(*) AS n FROM s UNION ALL SELECT false, count(*) FROM s a JOIN s b ON a.p = b.p AND a.o <> b.o",
    ),
    "varlen_events": (
        "MATCH (a:Event {event_type: 'signup'})-[:NEXT*1..3]->(b:Event {event_type: 'purchase'}) RETURN a.user_id AS u, count(*) AS n",
        """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT a.user_id AS u, count(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND b.k BETWEEN a.k + 1 AND a.k + 3
           WHERE a.event_type = 'signup' AND b.event_type = 'purchase' GROUP BY 1""",
    ),
    "named_path_length": (
        "MATCH p = (a:Turn {turn: 0})-[:REPLY*1..4]->(b) RETURN length(p) AS hops, count(*) AS n",
        "SELECT b.turn AS hops, count(*) AS n FROM conversations b WHERE b.turn BETWEEN 1 AND 4 GROUP BY 1",
    ),
    "path_nodes": (
        "MATCH p = (a:Turn {turn: 0})-[:REPLY*2]->(b) RETURN a.conv_id AS c, [x IN nodes(p) | x.role] AS roles, [x IN relationships(p) | type(x)] AS types",
        """SELECT a.conv_id AS c, [a.role, b.role, d.role] AS roles, ['REPLY', 'REPLY'] AS types FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = 1 JOIN conversations d ON a.conv_id = d.conv_id AND d.turn = 2 WHERE a.turn = 0""",
    ),
    "shortest_path": (
        "MATCH p = shortestPath((a:Turn {turn: 1})-[:REPLY*1..6]->(b:Turn {turn: 5})) RETURN a.conv_id AS c, length(p) AS hops",
        "SELECT conv_id AS c, CAST(4 AS BIGINT) AS hops FROM conversations WHERE turn = 5",
    ),
    "bound_relationship": (
        "MATCH (:Customer)-[r:PLACED]->() WITH r MATCH (c:Customer {c_mktsegment: 'MACHINERY'})-[r]->(o:Order) RETURN o.o_orderstatus AS s, count(*) AS n",
        "SELECT o_orderstatus AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' GROUP BY 1",
    ),
    "start_end_node": (
        "MATCH (:Nation)-[r:IN_REGION]->() RETURN startNode(r).n_name AS nation, endNode(r).r_name AS region",
        "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "optional_match": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {o_orderpriority: '1-URGENT'}) RETURN c.c_custkey AS c, count(o) AS n",
        "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1",
    ),
    "optional_match_where": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > c.c_acctbal * 60 RETURN c.c_custkey AS c, o.o_orderkey AS o",
        "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 60",
    ),
    "cartesian": ("MATCH (r:Region), (n:Nation) WHERE n.n_nationkey < 3 RETURN r.r_name AS r, n.n_name AS n", "SELECT r_name AS r, n_name AS n FROM region, nation WHERE n_nationkey < 3"),
    "value_join": (
        "MATCH (a:Customer), (b:Supplier) WHERE a.c_nationkey = b.s_nationkey AND a.c_acctbal > 9900 RETURN a.c_custkey AS a, b.s_suppkey AS b",
        "SELECT c_custkey AS a, s_suppkey AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9900",
    ),
    "theta_join": ("MATCH (a:Region), (b:Region) WHERE a.r_name < b.r_name RETURN a.r_name AS a, b.r_name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_name < b.r_name"),
    "exists_pattern": (
        "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 } RETURN c.c_custkey AS c",
        "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    ),
    "exists_subquery": (
        "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 15 RETURN n } RETURN c.c_custkey AS c",
        "SELECT o_custkey AS c FROM orders GROUP BY 1 HAVING count(*) > 15",
    ),
    "exists_in_return": (
        "MATCH (n:Nation) RETURN n.n_name AS n, EXISTS { (n)<-[:BASED_IN]-(s:Supplier) WHERE s.s_acctbal > 9000 } AS rich",
        "SELECT n_name AS n, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS rich FROM nation",
    ),
    "not_exists": (
        "MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->(:Order {o_orderstatus: 'P'}) } RETURN count(*) AS n",
        "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    ),
    "pattern_predicate": ("MATCH (t:Turn) WHERE NOT (t)-[:REPLY]->() RETURN t.turn AS turn, count(*) AS n", "SELECT turn, count(*) AS n FROM (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1) GROUP BY 1"),
    "pattern_comprehension": (
        "MATCH (r:Region) RETURN r.r_name AS r, size([(r)<-[:IN_REGION]-(n) WHERE n.n_nationkey > 5 | n.n_name]) AS n",
        "SELECT r_name AS r, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 5 GROUP BY 1",
    ),
    "with_chain": (
        "MATCH (c:Customer)-[:PLACED]->(o) WITH c.c_mktsegment AS seg, count(o) AS n, max(o.o_totalprice) AS top WITH seg, n, top WHERE n > 10 RETURN seg, n, top",
        "SELECT c_mktsegment AS seg, count(*) AS n, max(o_totalprice) AS top FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 10",
    ),
    "with_where": ("MATCH (p:Part) WITH p, p.p_size * 2 AS twice WHERE twice > 90 AND p.p_size < 49 RETURN p.p_partkey AS p, twice", "SELECT p_partkey AS p, CAST(p_size * 2 AS BIGINT) AS twice FROM part WHERE p_size * 2 > 90 AND p_size < 49"),
    "return_distinct": ("MATCH (p:Part) RETURN DISTINCT p.p_brand AS b, p.p_size AS s", "SELECT DISTINCT p_brand AS b, CAST(p_size AS BIGINT) AS s FROM part"),
    "order_by_nulls": (
        "MATCH (c:Customer) WITH c.c_custkey AS k, CASE WHEN c.c_custkey % 3 = 0 THEN null ELSE c.c_acctbal END AS b ORDER BY b DESC, k SKIP 20 LIMIT 70 RETURN k, b",
        "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS b FROM customer ORDER BY b DESC NULLS FIRST, k LIMIT 70 OFFSET 20",
    ),
    "skip_limit": ("MATCH (o:Order) RETURN o.o_orderkey AS k ORDER BY k SKIP 10 LIMIT 5", "SELECT o_orderkey AS k FROM orders ORDER BY k LIMIT 5 OFFSET 10"),
    "topk": ("MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k LIMIT 25", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 25"),
    "unwind_list": ("UNWIND [3, 1, null, 2] AS x RETURN x, x * 2 AS y", "SELECT x, x * 2 AS y FROM (VALUES (CAST(3 AS BIGINT)), (1), (NULL), (2)) t(x)"),
    "unwind_range": ("UNWIND range(1, 100000) AS x RETURN sum(x) AS s, count(*) AS n", "SELECT CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM range(1, 100001) t(x)"),
    "union_distinct": (
        "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k",
        "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    ),
    "union_all": (
        "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k",
        "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    ),
    "count_star": ("MATCH (o:Order) RETURN o.o_orderpriority AS p, count(*) AS n", "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1"),
    "count_distinct": ("MATCH (:Order)-[l:CONTAINS]->(p:Part) RETURN p.p_brand AS b, count(DISTINCT l.l_quantity) AS q, count(DISTINCT p) AS p", "SELECT p_brand AS b, count(DISTINCT l_quantity) AS q, count(DISTINCT p_partkey) AS p FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1"),
    "sum_empty": ("MATCH (p:Part) WHERE p.p_size < 0 RETURN sum(p.p_size) AS s, count(*) AS n, avg(p.p_size) AS a, collect(p.p_size) AS l", "SELECT CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS a, CAST([] AS BIGINT[]) AS l"),
    "avg": ("MATCH (p:Part) RETURN p.p_brand AS b, round(avg(p.p_size) * 10000) / 10000 AS a, round(avg(DISTINCT p.p_size) * 10000) / 10000 AS d, sum(DISTINCT p.p_size) AS t", "SELECT p_brand AS b, round(avg(p_size) * 10000) / 10000 AS a, round(avg(DISTINCT p_size) * 10000) / 10000 AS d, CAST(sum(DISTINCT p_size) AS BIGINT) AS t FROM part GROUP BY 1"),
    "min_max": ("MATCH (c:Customer) RETURN c.c_mktsegment AS s, min(c.c_acctbal) AS lo, max(c.c_acctbal) AS hi, min(c.c_name) AS first", "SELECT c_mktsegment AS s, min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_name) AS first FROM customer GROUP BY 1"),
    "collect": (
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, n ORDER BY n.n_name WITH r.r_name AS r, collect(n.n_name) AS l UNWIND l AS x WITH r, x ORDER BY x RETURN r, collect(x) AS names, size(collect(x)) AS n",
        "SELECT r_name AS r, list(n_name ORDER BY n_name) AS names, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "collect_distinct": ("MATCH (p:Part) WITH p.p_brand AS b, collect(DISTINCT p.p_type) AS l UNWIND l AS x RETURN b, x", "SELECT DISTINCT p_brand AS b, p_type AS x FROM part"),
    "percentile_disc": ("MATCH (p:Part) RETURN p.p_brand AS b, percentileDisc(p.p_size, 0.3) AS v", "SELECT p_brand AS b, CAST(quantile_disc(p_size, 0.3) AS BIGINT) AS v FROM part GROUP BY 1"),
    "percentile_cont": ("MATCH (p:Part) RETURN p.p_brand AS b, round(percentileCont(p.p_size, 0.3) * 1000) / 1000 AS v", "SELECT p_brand AS b, round(quantile_cont(CAST(p_size AS DOUBLE), 0.3) * 1000) / 1000 AS v FROM part GROUP BY 1"),
    "implicit_grouping": (
        "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN n.n_name AS n, c.c_mktsegment AS s, count(*) AS c, count(*) * 2 + size(n.n_name) AS mixed",
        "SELECT n_name AS n, c_mktsegment AS s, count(*) AS c, count(*) * 2 + length(n_name) AS mixed FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
    ),
    "call_subquery": ("CALL { MATCH (r:Region) RETURN count(*) AS regions } MATCH (n:Nation) RETURN n.n_name AS n, regions", "SELECT n_name AS n, (SELECT count(*) FROM region) AS regions FROM nation"),
    "call_correlated": (
        "MATCH (c:Customer) CALL { WITH c MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 250000 RETURN count(o) AS n, sum(o.o_totalprice) AS s } RETURN c.c_custkey AS c, n, round(s) AS s",
        "SELECT c_custkey AS c, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0)) AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 GROUP BY 1",
    ),
    "call_correlated_limit": (
        "MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:LIVES_IN]-(c:Customer) RETURN c.c_custkey AS k, c.c_acctbal AS b ORDER BY b DESC, k LIMIT 3 } RETURN n.n_name AS n, k, b",
        "SELECT n_name AS n, c_custkey AS k, c_acctbal AS b FROM nation JOIN customer ON c_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3",
    ),
    "call_procedure": ("UNWIND [1, 2] AS x CALL math.add(x, 0.5) YIELD result AS r RETURN x, r", "SELECT x, x + CAST(0.5 AS DOUBLE) AS r FROM (VALUES (CAST(1 AS BIGINT)), (2)) t(x)"),
    "case_simple": ("MATCH (o:Order) RETURN CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, count(*) AS n FROM orders GROUP BY 1"),
    "case_searched": ("MATCH (p:Part) RETURN CASE WHEN p.p_size < 10 THEN 'S' WHEN p.p_size < 30 THEN 'M' ELSE 'L' END AS c, count(*) AS n", "SELECT CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' ELSE 'L' END AS c, count(*) AS n FROM part GROUP BY 1"),
    "list_comprehension": (
        "MATCH (p:Part) RETURN p.p_partkey AS p, [x IN range(1, p.p_size) WHERE x % 7 = 0 | x * x] AS l",
        "SELECT p_partkey AS p, list_transform(list_filter(range(1, CAST(p_size AS BIGINT) + 1), lambda x: x % 7 = 0), lambda x: x * x) AS l FROM part",
    ),
    "quantifiers": (
        "MATCH (p:Part) WITH p, range(p.p_size, p.p_size + 2) AS l RETURN any(x IN l WHERE x % 5 = 0) AS a, all(x IN l WHERE x > 20) AS b, none(x IN l WHERE x = 30) AS c, single(x IN l WHERE x % 2 = 0) AS d, count(*) AS n",
        "SELECT s % 5 IN (0, 4, 3) AS a, s > 20 AS b, s NOT IN (28, 29, 30) AS c, s % 2 = 1 AS d, count(*) AS n FROM (SELECT p_size AS s FROM part) GROUP BY 1, 2, 3, 4",
    ),
    "reduce": ("MATCH (p:Part) RETURN p.p_partkey AS p, reduce(s = 0, x IN range(1, p.p_size) | s + x * x) AS s", "SELECT p_partkey AS p, CAST(p_size * (p_size + 1) * (2 * p_size + 1) // 6 AS BIGINT) AS s FROM part"),
    "list_index_slice": (
        "MATCH (p:Part) WITH p, range(1, p.p_size) AS l RETURN p.p_partkey AS p, l[0] AS first, l[-1] AS last, l[99] AS none, size(l[2..5]) AS n, head(tail(l)) AS second",
        "SELECT p_partkey AS p, CAST(1 AS BIGINT) AS first, CAST(p_size AS BIGINT) AS last, CAST(NULL AS BIGINT) AS none, CAST(least(greatest(p_size - 2, 0), 3) AS BIGINT) AS n, CAST(CASE WHEN p_size > 1 THEN 2 END AS BIGINT) AS second FROM part",
    ),
    "in_list_null": (
        "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_nationkey IN [1, 2, null] AS a, n.n_nationkey IN [] AS b, null IN [] AS c, [n.n_nationkey, null] = [1, null] AS d",
        "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey IN (1, 2) THEN true END AS a, false AS b, false AS c, CASE WHEN n_nationkey <> 1 THEN false END AS d FROM nation",
    ),
    "string_fns": (
        "MATCH (p:Part) RETURN p.p_partkey AS p, toUpper(p.p_name) AS u, toLower(p.p_type) AS l, substring(p.p_name, 2, 4) AS s, left(p.p_name, 3) AS a, right(p.p_name, 3) AS b, reverse(p.p_brand) AS r, replace(p.p_brand, 'Brand', 'B') AS t, size(p.p_name) AS n, trim('  x ') AS x",
        """SELECT p_partkey AS p, upper(p_name) AS u, lower(p_type) AS l, substring(p_name, 3, 4) AS s, left(p_name, 3) AS a, right(p_name, 3) AS b, reverse(p_brand) AS r, replace(p_brand, 'Brand', 'B') AS t, length(p_name) AS n, 'x' AS x FROM part""",
    ),
    "string_tests": (
        "MATCH (p:Part) WHERE p.p_brand STARTS WITH 'Brand#1' AND p.p_type CONTAINS 'A' AND NOT p.p_name ENDS WITH '7' RETURN p.p_partkey AS p, p.p_brand + '/' + toString(p.p_size) AS b",
        "SELECT p_partkey AS p, p_brand || '/' || p_size AS b FROM part WHERE starts_with(p_brand, 'Brand#1') AND contains(p_type, 'A') AND NOT ends_with(p_name, '7')",
    ),
    "split_fns": ("MATCH (o:Order) RETURN DISTINCT split(o.o_orderpriority, '-') AS parts, split('a.b', '.') AS dots, split('ab', '') AS letters", "SELECT DISTINCT string_split(o_orderpriority, '-') AS parts, ['a', 'b'] AS dots, ['', 'a', 'b', ''] AS letters FROM orders"),
    "math_fns": (
        "MATCH (s:Supplier) RETURN s.s_suppkey AS k, abs(s.s_acctbal) AS a, sign(s.s_acctbal) AS g, ceil(s.s_acctbal) AS c, floor(s.s_acctbal) AS f, round(s.s_acctbal) AS r, round(sqrt(abs(s.s_acctbal)) * 1000) AS q, round(log(10) * 1000) AS l, rand() AS z, 2 ^ 3 AS p",
        """SELECT s_suppkey AS k, abs(s_acctbal) AS a, CAST(sign(s_acctbal) AS BIGINT) AS g, CAST(ceil(s_acctbal) AS DOUBLE) AS c, CAST(floor(s_acctbal) AS DOUBLE) AS f, round(s_acctbal) AS r, round(sqrt(abs(s_acctbal)) * 1000) AS q, CAST(2303 AS DOUBLE) AS l,
           CAST(0.42 AS DOUBLE) AS z, CAST(8 AS DOUBLE) AS p FROM supplier""",
    ),
    "int_div_mod": ("UNWIND [7, -7, 0] AS x RETURN x, x / 2 AS d, x % 3 AS m, x / 0 AS z, x / 2.0 AS f", "SELECT x, x // 2 AS d, x % 3 AS m, CAST(NULL AS BIGINT) AS z, x / CAST(2 AS DOUBLE) AS f FROM (VALUES (CAST(7 AS BIGINT)), (-7), (0)) t(x)"),
    "conversions": (
        "UNWIND ['1', '1.7', 'x', null] AS s RETURN s, toInteger(s) AS i, toFloat(s) AS f, toBoolean(s) AS b, toString(1.0) AS one, toString(2.5) AS half, toBoolean('TRUE') AS t",
        "SELECT s, CASE WHEN s <> 'x' THEN CAST(1 AS BIGINT) END AS i, try_cast(s AS DOUBLE) AS f, CAST(NULL AS BOOLEAN) AS b, '1' AS one, '2.5' AS half, true AS t FROM (VALUES ('1'), ('1.7'), ('x'), (NULL)) v(s)",
    ),
    "coalesce": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 450000 RETURN c.c_custkey AS c, coalesce(o.o_orderkey, -1) AS o", "SELECT c_custkey AS c, coalesce(o_orderkey, -1) AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000"),
    "map_access": (
        "MATCH (n:Nation) WITH {name: n.n_name, pos: {k: n.n_nationkey}} AS m RETURN m.name AS name, m.pos.k AS k, m['name'] AS again, m.none AS none, size(keys(m)) AS n",
        "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS k, n_name AS again, CAST(NULL AS VARCHAR) AS none, CAST(2 AS BIGINT) AS n FROM nation",
    ),
    "keys_properties": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, keys(n) AS keys, properties(n).n_name AS name, labels(n) AS labels", "SELECT CAST(n_nationkey AS BIGINT) AS k, ['n_nationkey', 'n_name', 'n_regionkey'] AS keys, n_name AS name, ['Nation'] AS labels FROM nation"),
    "date_accessors": (
        "MATCH (o:Order) RETURN o.o_orderdate.year AS y, o.o_orderdate.quarter AS q, o.o_orderdate.month AS m, o.o_orderdate.week AS w, o.o_orderdate.weekDay AS d, o.o_orderdate.ordinalDay AS n, count(*) AS c",
        "SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, week(o_orderdate) AS w, isodow(o_orderdate) AS d, dayofyear(o_orderdate) AS n, count(*) AS c FROM orders GROUP BY ALL",
    ),
    "date_truncate": (
        "MATCH (o:Order) RETURN date.truncate('month', o.o_orderdate) AS m, date.truncate('week', o.o_orderdate) AS w, date.truncate('decade', o.o_orderdate) AS d, count(*) AS n",
        "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_trunc('week', o_orderdate) AS DATE) AS w, CAST(date_trunc('decade', o_orderdate) AS DATE) AS d, count(*) AS n FROM orders GROUP BY ALL",
    ),
    "duration_between": (
        "MATCH (o:Order)-[l:CONTAINS]->() RETURN duration.inDays(date(o.o_orderdate), date(l.l_shipdate)).days AS d, count(*) AS n",
        "SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    ),
    "date_plus_duration": (
        "MATCH (o:Order) RETURN o.o_orderkey AS k, date(o.o_orderdate) + duration({months: 1, days: 3}) AS d, date(o.o_orderdate) - duration('P1Y') AS e",
        "SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH + INTERVAL 3 DAY AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR AS DATE) AS e FROM orders",
    ),
    "date_construct": (
        "RETURN date({year: 2024, week: 7, dayOfWeek: 3}) AS a, date('2024-060') AS b, date({year: 2023, quarter: 3, dayOfQuarter: 11}) AS c, toString(localdatetime({year: 2024, month: 2, day: 29, hour: 13, minute: 5})) AS d, toString(datetime('2024-03-01T10:00:00+02:00')) AS e, toString(duration({hours: 25, minutes: 61})) AS f",
        "SELECT DATE '2024-02-14' AS a, DATE '2024-02-29' AS b, DATE '2023-07-11' AS c, '2024-02-29T13:05' AS d, '2024-03-01T10:00+02:00' AS e, 'PT26H1M' AS f",
    ),
}
CYPHER["parameters"] = ("MATCH (c:Customer) WHERE c.c_mktsegment = $segment AND c.c_nationkey IN $nations RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'AUTOMOBILE' AND c_nationkey IN (1, 5, 9)")
CYPHER |= more.CYPHER
PARAMS = {"parameters": {"segment": "AUTOMOBILE", "nations": [1, 5, 9]}}


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_graph(spark, sf_dir).query(CYPHER[name][0], PARAMS.get(name))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run("flagship", spark, sf_dir)


def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 vectors nearest to a fixed one."""
    from ..operators.vector import knn

    query = [((i * 37) % 64 - 32) / 64 for i in range(64)]
    return knn(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", query, 10).select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_graph(spark, sf_dir).query("EXPLAIN MATCH (p:Part {p_partkey: 77}) RETURN p.p_name AS n").select(F.contains("plan", F.lit("PushedFilters")).alias("pushed"))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sales_graph(spark, sf_dir).statistics()
    return spark.createDataFrame([(k, n, x) for k, d in found.items() for n, x in sorted(d.items())], "kind string, name string, n long")


_QUERY_VECTOR = "[" + ", ".join(str(((i * 37) % 64 - 32) / 64) for i in range(64)) + "]"
OTHER: dict[str, tuple[Callable, str | None]] = {
    "vector_knn": (vector_knn, f"SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST({_QUERY_VECTOR} AS DOUBLE[])), 6) AS distance FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST({_QUERY_VECTOR} AS DOUBLE[])), vec_id LIMIT 10"),
    "explain": (explain, "SELECT true AS pushed"),
    "graph_statistics": (
        statistics,
        """SELECT 'nodes' AS kind, 'Customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'nodes', 'Supplier', count(*) FROM supplier UNION ALL SELECT 'nodes', 'Party', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
           UNION ALL SELECT 'nodes', 'Region', count(*) FROM region UNION ALL SELECT 'nodes', 'Nation', count(*) FROM nation UNION ALL SELECT 'nodes', 'Part', count(*) FROM part UNION ALL SELECT 'nodes', 'Order', count(*) FROM orders
           UNION ALL SELECT 'nodes', 'User', count(DISTINCT user_id) FROM events UNION ALL SELECT 'nodes', 'Event', count(*) FROM events UNION ALL SELECT 'nodes', 'Turn', count(*) FROM conversations
           UNION ALL SELECT 'relationships', 'IN_REGION', count(*) FROM nation UNION ALL SELECT 'relationships', 'LIVES_IN', count(*) FROM customer UNION ALL SELECT 'relationships', 'BASED_IN', count(*) FROM supplier
           UNION ALL SELECT 'relationships', 'PLACED', count(*) FROM orders UNION ALL SELECT 'relationships', 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'relationships', 'SHIPPED', count(*) FROM lineitem
           UNION ALL SELECT 'relationships', 'DID', count(*) FROM events UNION ALL SELECT 'relationships', 'NEXT', count(*) - count(DISTINCT user_id) FROM events UNION ALL SELECT 'relationships', 'REPLY', count(*) - count(DISTINCT conv_id) FROM conversations""",
    ),
} | writes.QUERIES | more.OTHER


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, name) for name in CYPHER} | {name: f for name, (f, _) in OTHER.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CYPHER.items()} | {name: sql for name, (_, sql) in OTHER.items() if sql}
