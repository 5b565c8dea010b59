"""Further catalogue entries: temporal values, names and scopes, imports, sinks, transactions, error codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cypher.errors import CypherError
from ..sources import importer, store
from ..sources.database import Database
from ..sources.graph import PropertyGraph
from ..sources.mapping import sales_graph
from ..sources.shared import work_path

#: name: (Cypher, SQL)
CYPHER: dict[str, tuple[str, str]] = {
    "time_accessors": ("MATCH (e:Event) RETURN e.ts.hour AS h, e.ts.minute AS m, e.ts.second AS s, count(*) AS n", "SELECT hour(ts) AS h, minute(ts) AS m, second(ts) AS s, count(*) AS n FROM events GROUP BY ALL"),
    "localdatetime_truncate": (
        "MATCH (e:Event) RETURN toString(localdatetime.truncate('day', e.ts)) AS d, toString(localtime.truncate('hour', e.ts)) AS h, count(*) AS n",
        "SELECT strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M') AS d, strftime(date_trunc('hour', ts), '%H:%M') AS h, count(*) AS n FROM events GROUP BY ALL",
    ),
    "duration_accessors": (
        "UNWIND range(0, 50) AS k WITH k, duration({days: k, hours: k, minutes: 61 * k}) AS d RETURN k, d.days AS days, d.hours AS h, d.minutes AS m, d.minutesOfHour AS r",
        "SELECT k, k AS days, (121 * k) // 60 AS h, 121 * k AS m, (121 * k) % 60 AS r FROM range(0, 51) t(k)",
    ),
    "duration_arithmetic": (
        "UNWIND range(1, 20) AS k RETURN k, (duration({days: k}) + duration({days: 1, hours: k})).days AS a, (duration({hours: k}) * 2).hours AS b, (duration({days: 2 * k}) / 2).days AS c, (duration({days: 9}) - duration({days: k})).days AS d",
        "SELECT k, k + 1 AS a, 2 * k AS b, k AS c, 9 - k AS d FROM range(1, 21) t(k)",
    ),
    "duration_in_units": (
        # months are counted from the earlier date on, as its SQL does; back from the 29th of February the 31st of January is not a whole month away
        "MATCH (o:Order)-[l:CONTAINS]->() WITH date(o.o_orderdate) AS a, date(l.l_shipdate) AS b RETURN duration.inSeconds(a, b).seconds AS s, CASE WHEN b < a THEN -duration.inMonths(b, a).months ELSE duration.inMonths(a, b).months END AS m, count(*) AS n",
        "SELECT 86400 * date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS s, datesub('month', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS m, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
    ),
    "zones": (
        "RETURN datetime('2024-01-15T12:00:00[Europe/Stockholm]').offset AS a, datetime('2024-07-15T12:00:00[Europe/Stockholm]').offset AS b, datetime('2024-07-15T12:00:00+05:30').epochSeconds AS c, toString(time('12:31:14+01:00')) AS d, datetime('2024-07-15T12:00:00-03:00').offsetMinutes AS e",
        "SELECT '+01:00' AS a, '+02:00' AS b, epoch(TIMESTAMP '2024-07-15 06:30:00')::BIGINT AS c, '12:31:14+01:00' AS d, CAST(-180 AS BIGINT) AS e",
    ),
    "epochs": (
        "UNWIND range(0, 30) AS k RETURN k, toString(datetime.fromEpoch(k * 3600, 0)) AS a, toString(datetime.fromEpochMillis(k * 86400000)) AS b",
        "SELECT k, strftime(make_timestamp(k * 3600000000), '%Y-%m-%dT%H:%MZ') AS a, strftime(make_timestamp(k * 86400000000), '%Y-%m-%dT%H:%MZ') AS b FROM range(0, 31) t(k)",
    ),
    "clocks": ("RETURN toString(date()) AS d, toString(localtime()) AS t, toString(localdatetime()) AS l", "SELECT '1970-01-01' AS d, '00:00' AS t, '1970-01-01T00:00' AS l"),
    "date_compare": ("MATCH (o:Order) WHERE date(o.o_orderdate) >= date('1995-01-01') AND date(o.o_orderdate) < date({year: 1996}) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1995-01-01' AND CAST(o_orderdate AS DATE) < DATE '1996-01-01'"),
    "varlen_variable": (
        "MATCH (a:Turn {turn: 0})-[rs:REPLY*1..3]->(b) RETURN a.conv_id AS c, size(rs) AS n, all(r IN rs WHERE type(r) = 'REPLY') AS t, [r IN rs | type(r)][0] AS s",
        "SELECT conv_id AS c, turn AS n, true AS t, 'REPLY' AS s FROM conversations WHERE turn BETWEEN 1 AND 3",
    ),
    "varlen_bound_list": (
        "MATCH (a:Turn {turn: 0})-[rs:REPLY*2]->(b) WITH a, rs MATCH (a)-[rs*]->(y) RETURN a.conv_id AS c, y.turn AS t",
        "SELECT conv_id AS c, turn AS t FROM conversations WHERE turn = 2",
    ),
    "single_node_path": ("MATCH p = (r:Region) RETURN r.r_name AS r, length(p) AS l, size(nodes(p)) AS n", "SELECT r_name AS r, CAST(0 AS BIGINT) AS l, CAST(1 AS BIGINT) AS n FROM region"),
    "comma_uniqueness": ("MATCH (a:Nation)-[x:IN_REGION]->(r:Region), (b:Nation)-[y:IN_REGION]->(r) RETURN r.r_name AS r, count(*) AS n", "SELECT r_name AS r, count(*) * (count(*) - 1) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 HAVING count(*) > 1"),
    "string_slice": ("MATCH (p:Part) RETURN p.p_partkey AS p, p.p_name[1..3] AS s, p.p_name[-2..] AS c", "SELECT p_partkey AS p, substring(p_name, 2, 2) AS s, right(p_name, 2) AS c FROM part"),
    "constants": ("RETURN round(e() * 1000000) AS e, round(pi() * 1000000) AS p", "SELECT CAST(2718282 AS DOUBLE) AS e, CAST(3141593 AS DOUBLE) AS p"),
    "list_concat": ("MATCH (p:Part) RETURN p.p_partkey AS p, size([1, 2] + [p.p_size]) AS a, ([p.p_size] + 7)[1] AS b, (0 + [p.p_size])[1] AS c", "SELECT p_partkey AS p, CAST(3 AS BIGINT) AS a, CAST(7 AS BIGINT) AS b, CAST(p_size AS BIGINT) AS c FROM part"),
    "comparison_chain": ("MATCH (p:Part) WHERE 10 < p.p_size <= 20 RETURN p.p_partkey AS p", "SELECT p_partkey AS p FROM part WHERE p_size > 10 AND p_size <= 20"),
    "is_null": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 WITH c, o WHERE o IS NULL AND c.c_name IS NOT NULL RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "precedence": ("UNWIND range(0, 9) AS x RETURN x, 2 + x * 3 ^ 2 AS a, NOT x = 3 AND x > 1 OR x = 0 AS b, -x ^ 2 AS c, x % 4 + 1 = 2 XOR x > 7 AS d", "SELECT x, CAST(2 + x * 9 AS DOUBLE) AS a, (NOT x = 3 AND x > 1) OR x = 0 AS b, CAST(x * x AS DOUBLE) AS c, ((x % 4 + 1 = 2) <> (x > 7)) AS d FROM range(0, 10) t(x)"),
    "literals": ("RETURN 0x1F AS h, 0o17 AS o, 1.5e3 AS f, 'it\\'s' AS s, \"a\\tb\" AS t, `x y` AS q".replace("`x y` AS q", "true AS `x y`"), "SELECT CAST(31 AS BIGINT) AS h, CAST(15 AS BIGINT) AS o, CAST(1500 AS DOUBLE) AS f, 'it''s' AS s, 'a' || chr(9) || 'b' AS t, true AS \"x y\""),
    "comments": ("MATCH (r:Region) /* all\n of them */ RETURN count(*) AS n // the end", "SELECT count(*) AS n FROM region"),
    "return_star": ("MATCH (r:Region) WITH r.r_name AS a, r.r_regionkey AS b RETURN *", "SELECT r_name AS a, CAST(r_regionkey AS BIGINT) AS b FROM region"),
    "default_names": ("MATCH (r:Region) RETURN r.r_name, r.r_regionkey + 1", "SELECT r_name AS \"r.r_name\", CAST(r_regionkey + 1 AS BIGINT) AS \"r.r_regionkey + 1\" FROM region"),
    "with_limit_where": ("MATCH (c:Customer) WITH c.c_custkey AS k ORDER BY k LIMIT 50 WHERE k % 2 = 0 RETURN k", "SELECT k FROM (SELECT c_custkey AS k FROM customer ORDER BY k LIMIT 50) WHERE k % 2 = 0"),
    "distinct_skip_limit": ("MATCH (p:Part) RETURN DISTINCT p.p_size AS s ORDER BY s SKIP 3 LIMIT 5", "SELECT DISTINCT CAST(p_size AS BIGINT) AS s FROM part ORDER BY s LIMIT 5 OFFSET 3"),
    "order_by_aggregate": ("MATCH (p:Part) RETURN p.p_brand AS b, max(p.p_size) AS m ORDER BY max(p.p_size) DESC, b LIMIT 7", "SELECT p_brand AS b, CAST(max(p_size) AS BIGINT) AS m FROM part GROUP BY 1 ORDER BY m DESC, b LIMIT 7"),
    "as_of": (
        "MATCH (u:User)-[:DID]->(b:Event {event_type: 'purchase'}) OPTIONAL MATCH (u)-[:DID]->(a:Event {event_type: 'click'}) WHERE a.ts <= b.ts RETURN b.event_id AS b, max(a.event_id) AS a",
        "SELECT b.event_id AS b, max(a.event_id) AS a FROM events b LEFT JOIN events a ON a.user_id = b.user_id AND a.event_type = 'click' AND a.ts <= b.ts WHERE b.event_type = 'purchase' GROUP BY 1",
    ),
    "node_ids": ("MATCH (n:Party) RETURN count(DISTINCT id(n)) AS n", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n"),
    "type_of": ("MATCH (:Customer)-[r:LIVES_IN|PLACED]->() RETURN type(r) AS t, count(*) AS n", "SELECT 'LIVES_IN' AS t, count(*) AS n FROM customer UNION ALL SELECT 'PLACED', count(*) FROM orders"),
}


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _changed(updates: list[str], query: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = sales_graph(spark, sf_dir)
        for text in updates:
            g, _, _ = g.write(text)
        return g.query(query)

    return run


_RING = ["MATCH (a:Nation), (b:Nation) WHERE b.n_nationkey = (a.n_nationkey + 1) % 25 OR b.n_nationkey = (a.n_nationkey + 7) % 25 CREATE (a)-[:ROAD {w: 1}]->(b)"]
_RING_SQL = """WITH RECURSIVE e AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON b.n_nationkey IN ((a.n_nationkey + 1) % 25, (a.n_nationkey + 7) % 25)),
    w AS (SELECT a, b, CAST(1 AS BIGINT) AS hops FROM e UNION SELECT w.a, e.b, w.hops + 1 FROM w JOIN e ON e.a = w.b WHERE w.hops < 8), m AS (SELECT a, b, min(hops) AS hops FROM w GROUP BY 1, 2)"""


def mixed_read_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that an updating query returns."""
    return sales_graph(spark, sf_dir).write("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, count(n) AS k CREATE (s:Summary {nations: k}) WITH r, s MATCH (r)<-[:IN_REGION]-(n) RETURN r.r_name AS r, s.nations AS k, count(n) AS n")[1]


def write_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, counts = sales_graph(spark, sf_dir).write("MATCH (r:Region) CREATE (r)-[:HAS]->(:Copy:Second {k: r.r_regionkey})")
    return _rows(spark, sorted(counts.items()), "name string, n long")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a label: in a transaction, after its rollback, after another one's commit."""
    d = Database(spark, graph=sales_graph(spark, sf_dir))
    count = lambda x: x.query("MATCH (n:Copy) RETURN count(*) AS n").first().n
    t = d.begin()
    t.write("MATCH (r:Region) CREATE (:Copy {k: r.r_regionkey})")
    inside = count(t)
    t.rollback()
    undone = count(d)
    with d.begin() as t:
        t.write("MATCH (n:Nation) CREATE (:Copy {k: n.n_nationkey})")
        t.write("MATCH (n:Copy) WHERE n.k < 5 DELETE n")
    return _rows(spark, [("inside", inside), ("undone", undone), ("committed", count(d))], "at string, n long")


def _nation_files(spark: SparkSession, sf_dir: str, kind: str) -> tuple[str, str]:
    at = work_path(spark, f"import-{kind}")
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    if kind == "csv":
        nodes = nation.selectExpr("n_nationkey + 1000 AS `id:ID`", "'N;Place' AS `:LABEL`", "n_name AS name", "n_regionkey AS `r:int`").union(region.selectExpr("r_regionkey", "'R'", "r_name", "null"))
        rels = nation.selectExpr("n_nationkey + 1000 AS `:START_ID`", "n_regionkey AS `:END_ID`", "'IN' AS `:TYPE`", "n_nationkey * 0.5 AS `w:float`")
        nodes.write.option("header", "true").csv(f"{at}/nodes")
        rels.write.option("header", "true").csv(f"{at}/rels")
    else:
        nation.selectExpr("n_nationkey + 1000 AS id", "'N' AS label", "struct(n_name AS name, n_regionkey AS r) AS properties").unionByName(region.selectExpr("r_regionkey AS id", "'R' AS label", "struct(r_name AS name, CAST(null AS int) AS r) AS properties")).write.json(f"{at}/nodes")
        nation.selectExpr("n_nationkey + 1000 AS src", "n_regionkey AS dst", "'IN' AS type", "struct(n_nationkey * 0.5D AS w) AS properties").write.json(f"{at}/rels")
    return f"{at}/nodes", f"{at}/rels"


def _imported(spark: SparkSession, sf_dir: str, kind: str) -> PropertyGraph:
    nodes, rels = _nation_files(spark, sf_dir, kind)
    if kind == "csv":
        return importer.graph_of(importer.nodes_csv(spark, nodes), importer.rels_csv(spark, rels))
    return importer.graph_of(importer.nodes_jsonl(spark, nodes), importer.rels_jsonl(spark, rels))


_IMPORTED = "MATCH (n:N)-[x:IN]->(r:R) RETURN n.name AS n, r.name AS r, n.r AS k, x.w AS w"
_IMPORTED_SQL = "SELECT n_name AS n, r_name AS r, CAST(n_regionkey AS BIGINT) AS k, n_nationkey * CAST(0.5 AS DOUBLE) AS w FROM nation JOIN region ON n_regionkey = r_regionkey"


def create_after_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Things created after an import have ids of their own."""
    g, _, _ = _imported(spark, sf_dir, "csv").write("MATCH (n:N) CREATE (n)-[:IS]->(:Copy {of: n.name})")
    return g.query("MATCH (n) OPTIONAL MATCH (n)-[r]->() RETURN count(DISTINCT id(n)) AS n, count(DISTINCT id(r)) AS r")


def stored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save, change, save, back up, restore, vacuum."""
    at, to = work_path(spark, "store"), work_path(spark, "backup")
    g = _imported(spark, sf_dir, "csv")
    store.save(g, at)
    store.save(g.write("MATCH (r:R) DETACH DELETE r")[0], at)
    store.backup(spark, at, to, 1)
    store.restore(spark, to, at)
    count = lambda n: store.load(spark, at, n).query("MATCH (n) RETURN count(*) AS n").first().n
    out = [(n, count(n)) for n in store.versions(spark, at)]
    store.vacuum(spark, at)
    return _rows(spark, [*out, *[(10 + n, count(n)) for n in store.versions(spark, at)]], "version long, nodes long")


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importer.as_json(sales_graph(spark, sf_dir).query("MATCH (r:Region) RETURN r.r_name AS name, r.r_regionkey AS k, r.nothing AS x"))


def ndjson_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{work_path(spark, 'sink')}/rows"
    importer.to_ndjson(sales_graph(spark, sf_dir).query("MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.n_name AS n, r.r_name AS r"), at)
    return spark.read.schema("n string, r string").json(at)


_NEAR = [((i * 29) % 64 - 32) / 64 for i in range(64)]


def knn_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest nodes of a label, among those loaded and one created later."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    nodes = vectors.select(F.col("vec_id").cast("long").alias("id"), F.array(F.when(F.col("vec_id") % 2 == 0, "Even").otherwise("Odd")).alias("labels"), F.col("embedding").cast("array<double>").alias("embedding"))
    g, _, _ = PropertyGraph.from_frames(spark, nodes).write("CREATE (:Odd {embedding: $v})", {"v": _NEAR})
    return g.knn("Odd", "embedding", _NEAR, 8).select(F.when(F.col("distance") == 0, -1).otherwise(F.col("id")).cast("long").alias("id"), F.round("distance", 6).alias("distance"))


def implicit_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_graph(spark, sf_dir).query("CALL math.add", {"a": 10, "b": 20})


def own_procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered table procedure over a column."""
    g = PropertyGraph(spark, **{n: getattr(sales_graph(spark, sf_dir), n) for n in ("nodes", "rels", "slots", "next_id", "made")})
    g.register_procedure("text.parts", ["s", "by"], {"part": T.StringType()}, lambda s, by: F.transform(F.split(s, F.concat(F.lit("\\Q"), by, F.lit("\\E"))), lambda x: F.struct(x.alias("part"))))
    return g.query("MATCH (o:Order) WITH DISTINCT o.o_orderpriority AS p CALL text.parts(p, '-') YIELD part RETURN p, part")


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_graph(spark, sf_dir).create_index("Part", "p_size").query("MATCH (p:Part) WHERE p.p_size = 7 RETURN p.p_partkey AS p")


#: (query, code); those that begin with ! go through the updating API.
ERRORS = [
    ("RETURN x", "UndefinedVariable"), ("MATCH (n)-[n]->() RETURN n", "VariableTypeConflict"), ("MATCH (n) UNWIND [1] AS n RETURN n", "VariableAlreadyBound"), ("RETURN 1 AS a, 2 AS a", "ColumnNameConflict"), ("WITH 1 + 1 RETURN 1 AS x", "NoExpressionAlias"),
    ("RETURN 1 AS a UNION RETURN 2 AS b", "DifferentColumnsInUnion"), ("MATCH (n) WHERE count(n) > 1 RETURN n", "InvalidAggregation"), ("RETURN count(count(*)) AS x", "NestedAggregation"), ("MATCH (n) RETURN n.name + count(*) AS x", "AmbiguousAggregationExpression"),
    ("RETURN nope(1) AS x", "UnknownFunction"), ("MATCH (n) RETURN n SKIP -1", "NegativeIntegerArgument"), ("MATCH (n) RETURN n LIMIT 1.5", "InvalidArgumentType"), ("MATCH (n) RETURN n LIMIT n.age", "NonConstantExpression"), ("MATCH (n) RETURN (n)-->() AS x", "UnexpectedSyntax"),
    ("CALL no.such()", "ProcedureNotFound"), ("CALL math.add(1)", "InvalidNumberOfArguments"), ("CALL math.add", "MissingParameter"), ("MATCH (p:Part) RETURN percentileDisc(p.p_size, 2) AS x", "NumberOutOfRange"), ("RETURN *", "NoVariablesInScope"),
    ("CREATE (n) RETURN n", "InvalidClauseComposition"), ("RETURN toInteger([1]) AS x", "InvalidArgumentValue"), ("MATCH (n) WHERE exists(n.x) RETURN n", "UnexpectedSyntax"),
    ("!CREATE (a)-[:R*2]->(b)", "CreatingVarLength"), ("!CREATE (a)-[:R]-(b)", "RequiresDirectedRelationship"), ("!CREATE (a)-[:R|S]->(b)", "NoSingleRelationshipType"), ("!CREATE (a {x: [{y: 1}]})", "InvalidPropertyType"), ("!WITH 1 AS x DELETE x", "InvalidDelete"),
    ("!MATCH (r:Region) DELETE r", "DeleteConnectedNode"),
]


def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, out = sales_graph(spark, sf_dir), []
    for text, _ in ERRORS:
        try:
            g.write(text[1:]) if text[0] == "!" else g.query(text)
            code = "none"
        except CypherError as e:
            code = e.code
        out.append((text, code))
    return _rows(spark, out, "query string, code string")


_ERRORS_SQL = "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(q.replace("'", "''"), c) for q, c in ERRORS) + ") t(query, code)"

OTHER: dict[str, tuple[Callable, str]] = {
    "merge_row_props": (
        _changed(["MATCH (n:Nation)-[:IN_REGION]->(r:Region) MERGE (s:Sum {of: r.r_name}) ON CREATE SET s.made = r.r_regionkey, s.hits = 0 ON MATCH SET s.hits = r.r_regionkey + 100"], "MATCH (s:Sum) RETURN s.of AS r, s.made AS made, s.hits AS hits"),
        "SELECT r_name AS r, CAST(r_regionkey AS BIGINT) AS made, CAST(CASE WHEN count(*) > 1 THEN r_regionkey + 100 ELSE 0 END AS BIGINT) AS hits FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey",
    ),
    "merge_own_rows": (_changed(["UNWIND [1, 1, 1, 2] AS x MERGE (m:M {k: x}) ON CREATE SET m.seen = 1 ON MATCH SET m.seen = 2"], "MATCH (m:M) RETURN m.k AS k, m.seen AS seen"), "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(2 AS BIGINT)), (2, 1)) t(k, seen)"),
    "set_replace": (_changed(["MATCH (r:Region) SET r = {r_name: toLower(r.r_name), tag: 7}"], "MATCH (r:Region) RETURN r.r_name AS r, r.r_regionkey AS k, r.tag AS t"), "SELECT lower(r_name) AS r, CAST(NULL AS BIGINT) AS k, CAST(7 AS BIGINT) AS t FROM region"),
    "created_self_loop": (_changed(["MATCH (r:Region) CREATE (r)-[:SELF]->(r)", "MATCH (a:Region), (b:Region) WHERE a.r_regionkey < b.r_regionkey CREATE (a)-[:SELF]->(b)"], "MATCH (n)-[r:SELF]->(n) RETURN n.r_name AS r, count(r) AS n"), "SELECT r_name AS r, CAST(1 AS BIGINT) AS n FROM region"),
    "shortest_of_many": (
        _changed(_RING, "MATCH p = shortestPath((a:Nation {n_nationkey: 3})-[:ROAD*1..8]->(b:Nation)) RETURN b.n_nationkey AS b, length(p) AS hops"),
        _RING_SQL + " SELECT CAST(b AS BIGINT) AS b, hops FROM m WHERE a = 3",
    ),
    "all_shortest": (
        _changed(_RING, "MATCH p = allShortestPaths((a:Nation {n_nationkey: 3})-[:ROAD*1..8]->(b:Nation)) RETURN b.n_nationkey AS b, length(p) AS hops, count(*) AS n"),
        _RING_SQL.replace("UNION SELECT", "UNION ALL SELECT").replace("SELECT a, b, CAST(1 AS BIGINT) AS hops FROM e UNION", "SELECT a, b, CAST(1 AS BIGINT) AS hops FROM e WHERE a = 3 UNION") + " SELECT CAST(w.b AS BIGINT) AS b, w.hops, count(*) AS n FROM w JOIN m ON m.a = w.a AND m.b = w.b AND m.hops = w.hops WHERE w.a = 3 GROUP BY 1, 2",
    ),
    "mixed_read_write": (mixed_read_write, "SELECT r_name AS r, count(*) AS k, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "write_counts": (
        write_counts,
        "SELECT * FROM (SELECT unnest(['labels_added', 'labels_removed', 'nodes_created', 'nodes_deleted', 'properties_set', 'relationships_created', 'relationships_deleted']) AS name, unnest([2 * n, 0, n, 0, n, n, 0]) AS n FROM (SELECT count(*) AS n FROM region))",
    ),
    "transactions": (transactions, "SELECT 'inside' AS at, count(*) AS n FROM region UNION ALL SELECT 'undone', 0 UNION ALL SELECT 'committed', count(*) FROM nation WHERE n_nationkey >= 5"),
    "csv_import": (lambda spark, sf_dir: _imported(spark, sf_dir, "csv").query(_IMPORTED), _IMPORTED_SQL),
    "jsonl_import": (lambda spark, sf_dir: _imported(spark, sf_dir, "jsonl").query(_IMPORTED), _IMPORTED_SQL),
    "create_after_import": (create_after_import, "SELECT 2 * (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n, 2 * (SELECT count(*) FROM nation) AS r"),
    "stored_versions": (stored_versions, "SELECT CAST(v AS BIGINT) AS version, (SELECT count(*) FROM nation) + CASE WHEN v = 2 THEN 0 ELSE (SELECT count(*) FROM region) END AS nodes FROM (VALUES (1), (2), (3), (13)) t(v)"),
    "json_rows": (json_rows, "SELECT '{\"name\":\"' || r_name || '\",\"k\":' || r_regionkey || ',\"x\":null}' AS json FROM region"),
    "ndjson_sink": (ndjson_sink, "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "knn_label": (
        knn_label,
        f"SELECT * FROM (SELECT CAST(-1 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS distance UNION ALL SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST({_NEAR} AS DOUBLE[])), 6) FROM embeddings WHERE vec_id % 2 <> 0) ORDER BY distance, id LIMIT 8",
    ),
    "implicit_arguments": (implicit_arguments, "SELECT CAST(30 AS DOUBLE) AS result"),
    "own_procedure": (own_procedure, "SELECT p, unnest(string_split(p, '-')) AS part FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)"),
    "indexed": (indexed, "SELECT p_partkey AS p FROM part WHERE p_size = 7"),
    "error_codes": (error_codes, _ERRORS_SQL),
}
