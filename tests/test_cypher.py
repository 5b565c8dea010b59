import pytest

from tessella.cypher.errors import CypherError
from tessella.sources.graph import PropertyGraph


@pytest.fixture(scope="module")
def friends(spark):
    nodes = spark.createDataFrame([(0, ["Person"], "A", None), (1, ["Person"], "B", 20), (2, ["Person"], "C", 30), (3, ["Person", "X"], "D", 20), (4, ["Person"], "X", None), (5, ["Person"], "Y", 40)], "id long, labels array<string>, name string, age long")
    rels = spark.createDataFrame([(10, "KNOWS", 0, 1, 1), (11, "KNOWS", 0, 2, 2), (12, "KNOWS", 0, 3, 3), (13, "KNOWS", 4, 5, 4), (14, "LIKES", 1, 2, 5), (15, "LIKES", 2, 2, None)], "rid long, type string, src long, dst long, w long")
    return PropertyGraph.from_frames(spark, nodes, rels)


def rows(g, q, **params):
    return [tuple(r) for r in g.query(q, params).collect()]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("MATCH (n:Person)-[:KNOWS]->(f) RETURN n.name AS n, count(f) AS c, min(f.age) AS lo, max(f.age) AS hi ORDER BY n", [("A", 3, 20, 30), ("X", 1, 40, 40)]),
        ("MATCH (b {name: 'C'})<-[:KNOWS|LIKES]-(m) RETURN m.name AS n ORDER BY n", [("A",), ("B",), ("C",)]),
        ("MATCH (a {name: 'A'})-[:LOVES|KNOWS]->(b) RETURN count(*) AS n", [(3,)]),
        ("MATCH (a)-[:NOPE]->(b) RETURN count(*) AS n", [(0,)]),
        ("MATCH (n:Nope) RETURN count(*) AS n", [(0,)]),
        ("MATCH (a {name: 'C'})-[r]-(b) RETURN b.name AS n, type(r) AS t ORDER BY n, t", [("A", "KNOWS"), ("B", "LIKES"), ("C", "LIKES")]),
        ("MATCH (a:Person) OPTIONAL MATCH (a)-[:KNOWS]->(b) WHERE b.age > 25 RETURN a.name AS a, b.name AS b ORDER BY a", [("A", "C"), ("B", None), ("C", None), ("D", None), ("X", "Y"), ("Y", None)]),
        ("UNWIND [1, 1] AS x OPTIONAL MATCH (n {name: 'B'}) RETURN x, n.age AS a", [(1, 20), (1, 20)]),
        ("MATCH (a) WHERE NOT (a)-[:KNOWS]->() RETURN a.name AS n ORDER BY n", [("B",), ("C",), ("D",), ("Y",)]),
        ("MATCH (a) WHERE EXISTS { (a)-[:KNOWS]->(b) WHERE b.age > 35 } OR a.name = 'B' RETURN a.name AS n ORDER BY n", [("B",), ("X",)]),
        ("MATCH p = (a {name: 'A'})-[*1..3]->(b) RETURN [x IN nodes(p) | x.name] AS l ORDER BY length(p), l", [(["A", "B"],), (["A", "C"],), (["A", "D"],), (["A", "B", "C"],), (["A", "C", "C"],), (["A", "B", "C", "C"],)]),
        ("MATCH p = (b {name: 'C'})<-[*2]-(a) RETURN a.name AS a, [x IN nodes(p) | x.name] AS l ORDER BY a, l", [("A", ["C", "B", "A"]), ("A", ["C", "C", "A"]), ("B", ["C", "C", "B"])]),
        ("MATCH (a)-[*0..0]->(b) RETURN count(*) AS n", [(6,)]),
        ("MATCH (a)-[*3..2]->(b) RETURN count(*) AS n", [(0,)]),
        ("MATCH (n)-->(n) RETURN n.name AS n", [("C",)]),
        ("MATCH (a)-[r]->(b), (b)-[s]->(c) RETURN count(*) AS n", [(3,)]),
        ("MATCH p = (n {name: 'D'}) RETURN length(p) AS l, size(nodes(p)) AS n", [(0, 1)]),
        ("MATCH (n) RETURN DISTINCT n.age AS a ORDER BY a DESC SKIP 1 LIMIT 2", [(40,), (30,)]),
        ("MATCH (n) RETURN n.age AS a ORDER BY a DESC LIMIT 3", [(None,), (None,), (40,)]),
        ("MATCH (n) WITH n.age AS a, count(*) AS c WHERE c > 1 RETURN a, c ORDER BY c, a", [(20, 2), (None, 2)]),
        ("MATCH (n:X) RETURN labels(n) AS l, keys(n) AS k, id(n) AS i", [(["Person", "X"], ["name", "age"], 3)]),
        ("MATCH (a:Person) CALL { WITH a MATCH (a)-[:KNOWS]->(b) RETURN count(b) AS c } RETURN a.name AS n, c ORDER BY n LIMIT 2", [("A", 3), ("B", 0)]),
        ("MATCH (a {name: 'A'}) RETURN [(a)-[r:KNOWS]->(b) WHERE b.age = 20 | r.w] AS l", [([1, 3],)]),
        ("MATCH (x) RETURN max(x.age) AS m, sum(x.age) + count(*) AS s", [(40, 116)]),
    ],
)
def test_reading(friends, query, expected):
    got = rows(friends, query)
    assert [tuple(sorted(x) if isinstance(x, list) and query.startswith("MATCH (a {name: 'A'}) RETURN [") else x for x in r) for r in got] == expected


@pytest.mark.parametrize(
    ("expression", "expected"),
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("1 / 0", None), ("2 ^ 3", 8.0), ("9223372036854775807 + 1", None), ("-9223372036854775808 / -1", None), ("1.0 / 0", float("inf")),
        ("0.0 / 0.0 = 0.0 / 0.0", False), ("1 = 1.0", True), ("'a' = 1", False), ("'a' < 1", None), ("null = null", None), ("[1, null] = [1, null]", None), ("[1] = [1, 2]", False), ("{a: 1} = {b: 1}", False), ("{a: 1} = {a: 1.0}", True),
        ("null IN []", False), ("1 IN [2, null]", None), ("2 IN [2, null]", True), ("true XOR null", None), ("false AND null", False), ("'a' + 1", None), ("[1] + 2", [1, 2]), ("[1] + [2]", [1, 2]),
        ("substring('hello', 1, 3)", "ell"), ("substring('hello', 9)", ""), ("substring('hello', -1)", ""), ("left('abc', 0)", ""), ("right('abc', 2)", "bc"), ("replace('ab', '', '-')", "-a-b-"), ("split('ab', '')", ["", "a", "b", ""]),
        ("split('a.b', '.')", ["a", "b"]), ("reverse('añb')", "bña"), ("trim(' \t x ')", "x"), ("toString(1.0)", "1"), ("toString(1.5)", "1.5"), ("toString(true)", "true"), ("toInteger('1.7')", 1), ("toInteger('x')", None),
        ("toFloat('nan')", None), ("toBoolean('yes')", None), ("round(2.5)", 3.0), ("round(-2.5)", -3.0), ("sign(-3)", -1), ("log(0)", None), ("log(2, 8)", 3.0), ("range(5, 1)", []), ("range(5, 1, -2)", [5, 3, 1]), ("range(1, 2, 0)", None),
        ("[1, 2, 3][-1]", 3), ("[1, 2, 3][5]", None), ("[1, 2, 3][1..]", [2, 3]), ("[1, 2, 3][-2..-1]", [2]), ("[1, 2, 3][null..2]", None), ("size('añb')", 3), ("size([])", 0), ("head([])", None), ("last([1, 2])", 2), ("tail([1])", []),
        ("reduce(s = 0, x IN [1, 2] | s + x * 1.5)", 4.5), ("any(x IN [null, 1] WHERE x = 1)", True), ("all(x IN [null, 1] WHERE x = 1)", None), ("none(x IN [] WHERE x = 1)", True), ("single(x IN [1, 2, 1] WHERE x = 1)", False),
        ("coalesce(null, 2, 3)", 2), ("CASE 3 WHEN 1 THEN 'a' WHEN 3 THEN 'c' END", "c"), ("CASE WHEN null THEN 1 ELSE 2 END", 2), ("{a: {b: [1, 2]}}.a.b[1]", 2), ("rand()", 0.42), ("0x1F + 0o17", 46), ("'a' STARTS WITH null", None),
        ("toString(date({year: 2024, month: 2, day: 29}) + duration('P1Y'))", "2025-02-28"), ("toString(duration('P1Y2M10DT2H30M5.5S'))", "P1Y2M10DT2H30M5.5S"), ("toString(duration({days: 1.5}))", "P1DT12H"),
        ("toString(duration.between(date('2020-01-31'), date('2021-03-01')))", "P13M1D".replace("P13M", "P1Y1M")), ("duration.inMonths(date('2020-01-31'), date('2020-03-30')).months", 1), ("duration.inSeconds(localdatetime('2020-01-01T00:00'), localdatetime('2020-01-02T01:00')).hours", 25),
        ("toString(date.truncate('millennium', date('2024-05-05')))", "2000-01-01"), ("toString(date.truncate('weekYear', date('2024-12-31')))", "2024-12-30"), ("toString(date.truncate('month', date('2024-05-05'), {day: 3}))", "2024-05-03"),
        ("date('2024-W07-3').week", 7), ("date('2024-05-16').quarter", 2), ("localtime('12:31:14.645').millisecond", 645), ("toString(time('12:31:14+01:00'))", "12:31:14+01:00"), ("datetime('2024-01-01T00:00:00+02:00').epochSeconds", 1704060000),
        ("datetime('2024-07-01T12:00:00[Europe/Stockholm]').offset", "+02:00"), ("toString(date())", "1970-01-01"), ("toString(datetime.fromEpochMillis(1500))", "1970-01-01T00:00:01.5Z"), ("date('2020-01-01') < date('2020-01-02')", True),
        ("toString(duration('PT1H') * 2)", "PT2H"), ("toString(localdatetime('2024-01-31T23:00') + duration('P1MT2H'))", "2024-03-01T01:00"),
    ],
)
def test_expressions(friends, expression, expected):
    assert rows(friends, f"RETURN {expression} AS x") == [(expected,)]


@pytest.mark.parametrize(
    ("query", "code"),
    [
        ("RETURN x", "UndefinedVariable"), ("MATCH (n) WHERE m.x = 1 RETURN n", "UndefinedVariable"), ("MATCH (n)-[n]->() RETURN n", "VariableTypeConflict"), ("MATCH (n) UNWIND [1] AS n RETURN n", "VariableAlreadyBound"),
        ("RETURN 1 AS a, 2 AS a", "ColumnNameConflict"), ("WITH 1 + 1 RETURN 1 AS x", "NoExpressionAlias"), ("RETURN 1 AS a UNION RETURN 2 AS b", "DifferentColumnsInUnion"), ("MATCH (n) WHERE count(n) > 1 RETURN n", "InvalidAggregation"),
        ("RETURN count(count(*)) AS x", "NestedAggregation"), ("MATCH (n) RETURN n.name + count(*) AS x", "AmbiguousAggregationExpression"), ("RETURN nope(1) AS x", "UnknownFunction"), ("MATCH (n) RETURN n SKIP -1", "NegativeIntegerArgument"),
        ("MATCH (n) RETURN n LIMIT 1.5", "InvalidArgumentType"), ("MATCH (n) RETURN n LIMIT n.age", "NonConstantExpression"), ("MATCH (n) RETURN (n)-->() AS x", "UnexpectedSyntax"), ("CALL no.such()", "ProcedureNotFound"), ("CALL math.add(1)", "InvalidNumberOfArguments"),
        ("CALL math.add", "MissingParameter"), ("MATCH (n) RETURN percentileDisc(n.age, 2) AS x", "NumberOutOfRange"), ("RETURN *", "NoVariablesInScope"), ("RETURN length([1]) AS x", "InvalidArgumentType"), ("CREATE (n) RETURN n", "InvalidClauseComposition"),
        ("RETURN toInteger([1]) AS x", "InvalidArgumentValue"), ("MATCH (n) RETURN type(n) AS x", "InvalidArgumentType"), ("WITH 1 AS n MATCH (n) RETURN n", "VariableTypeConflict"),
    ],
)
def test_error_codes(friends, query, code):
    with pytest.raises(CypherError) as e:
        friends.query(query)
    assert e.value.code == code


def test_plan_reaches_the_scan(spark, tmp_path):
    """The filter and the columns of a query are those of its scan; no node table is read that isn't asked for."""
    spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(10)], "k long, name string, extra long").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(i, i, (i + 1) % 10) for i in range(10)], "r long, s long, d long").write.parquet(f"{tmp_path}/r")
    g = PropertyGraph(spark).add_nodes("A", spark.read.parquet(f"{tmp_path}/a"), "k").add_rels("R", spark.read.parquet(f"{tmp_path}/r"), ("A", "s"), ("A", "d"), "r")
    plan = g.query("EXPLAIN MATCH (a:A) WHERE a.name = 'n3' RETURN a.k AS k").first()[0]
    assert "EqualTo(name,n3)" in plan and "extra" not in plan
    plan = g.query("EXPLAIN MATCH (:A)-[x:R]->(:A) RETURN count(x) AS n").first()[0]
    assert "Join" not in plan
    assert rows(g, "MATCH (:A)-[x:R]->(:A) RETURN count(x) AS n") == [(10,)]


def test_procedures_of_ones_own(friends):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    friends.register_procedure("text.letters", ["s"], {"c": T.StringType()}, lambda s: F.transform(F.split(s, ""), lambda x: F.struct(x.alias("c"))))
    assert rows(friends, "CALL text.letters('ab') YIELD c RETURN c ORDER BY c DESC") == [("b",), ("a",)]


def test_statistics(friends):
    assert friends.statistics() == {"nodes": {"Person": 6, "X": 1}, "relationships": {"KNOWS": 4, "LIKES": 2}}


def test_bad_graphs(spark):
    nodes = spark.createDataFrame([(1, ["A"])], "id long, labels array<string>")
    with pytest.raises(ValueError):
        PropertyGraph.from_frames(spark, nodes, spark.createDataFrame([(1, "R", 1, 2)], "rid long, type string, src long, dst long"))
    with pytest.raises(ValueError):
        PropertyGraph.from_frames(spark, nodes.union(nodes))
