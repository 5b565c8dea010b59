"""Updating queries over the sales graph: what the changed graph holds."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..sources.mapping import sales_graph

#: name: (updates in turn, query on the result, SQL)
WRITES: dict[str, tuple[list[str], str, str]] = {
    "create_nodes": (
        ["MATCH (r:Region) CREATE (d:Desk {name: r.r_name + ' desk', size: size(r.r_name)})-[:SERVES {since: 2020}]->(r)"],
        "MATCH (d:Desk)-[s:SERVES]->(r:Region) RETURN d.name AS d, d.size AS n, s.since AS since, r.r_name AS r",
        "SELECT r_name || ' desk' AS d, length(r_name) AS n, CAST(2020 AS BIGINT) AS since, r_name AS r FROM region",
    ),
    "merge_nodes": (
        ["MATCH (c:Customer) MERGE (s:Segment {name: c.c_mktsegment}) ON CREATE SET s.seen = 1 ON MATCH SET s.seen = 2", "MERGE (s:Segment {name: 'NEW'}) ON CREATE SET s.seen = 1 ON MATCH SET s.seen = 2", "MERGE (s:Segment {name: 'NEW'}) ON MATCH SET s.seen = 2"],
        "MATCH (s:Segment) RETURN s.name AS s, s.seen AS seen",
        "SELECT c_mktsegment AS s, CASE WHEN count(*) > 1 THEN CAST(2 AS BIGINT) ELSE 1 END AS seen FROM customer GROUP BY 1 UNION ALL SELECT 'NEW', 2",
    ),
    "merge_relationship": (
        ["MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE c.c_acctbal > 0 MERGE (c)-[:IN]->(r)", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) MERGE (c)-[:IN]->(r)"],
        "MATCH (c:Customer)-[:IN]->(r:Region) RETURN r.r_name AS r, count(*) AS n",
        "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "set_props": (
        ["MATCH (n:Nation)<-[:BASED_IN]-(s:Supplier) WITH n, count(s) AS k SET n.suppliers = k, n.n_name = toLower(n.n_name)"],
        "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name, n.suppliers AS suppliers",
        "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN count(s_suppkey) > 0 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN count(s_suppkey) > 0 THEN count(s_suppkey) END AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name",
    ),
    "set_map_labels": (
        ["MATCH (r:Region) WHERE r.r_regionkey > 2 SET r += {tag: 'far'}, r:Far"],
        "MATCH (r:Region) RETURN r.r_name AS r, r.tag AS tag, r:Far AS far",
        "SELECT r_name AS r, CASE WHEN r_regionkey > 2 THEN 'far' END AS tag, r_regionkey > 2 AS far FROM region",
    ),
    "remove_props": (
        ["MATCH (r:Region) WHERE r.r_regionkey = 1 REMOVE r.r_name", "MATCH (p:Party) WHERE p.c_custkey < 10 REMOVE p:Party"],
        "MATCH (r:Region) WITH count(r.r_name) AS named MATCH (p:Party) RETURN named, count(p) AS parties",
        "SELECT count(*) - 1 AS named, (SELECT count(*) FROM customer WHERE c_custkey >= 10) + (SELECT count(*) FROM supplier) AS parties FROM region",
    ),
    "delete_detach": (
        ["MATCH (c:Customer) WHERE c.c_acctbal < 0 DETACH DELETE c"],
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[p:PLACED]->() RETURN count(DISTINCT c) AS customers, count(p) AS orders",
        "SELECT count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal >= 0",
    ),
    "delete_relationships": (
        ["MATCH (:Customer)-[r:LIVES_IN]->(n:Nation) WHERE n.n_nationkey > 20 DELETE r"],
        "MATCH (:Customer)-[r:LIVES_IN]->() RETURN count(r) AS n",
        "SELECT count(*) AS n FROM customer WHERE c_nationkey <= 20",
    ),
    "foreach_create": (
        ["MATCH (r:Region) FOREACH (x IN range(1, r.r_regionkey) | CREATE (:Slot {v: x * 10, of: r.r_name}))"],
        "MATCH (s:Slot) RETURN s.of AS r, s.v AS v",
        "SELECT r_name AS r, CAST(x * 10 AS BIGINT) AS v FROM region, range(1, 100) t(x) WHERE x <= r_regionkey",
    ),
}


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sales_graph(spark, sf_dir)
    for text in WRITES[name][0]:
        g, _, _ = g.write(text)
    return g.query(WRITES[name][1])


QUERIES = {name: (partial(_run, name), sql) for name, (_, _, sql) in WRITES.items()}
