import pytest

from tessella.cypher.errors import CypherError
from tessella.sources import importer, store
from tessella.sources.graph import PropertyGraph


def rows(g, q):
    return [tuple(r) for r in g.query(q).collect()]


def test_create_merge_set_remove_delete(spark):
    g, out, stats = PropertyGraph(spark).write("CREATE (a:Person {name: 'A', age: 1})-[:KNOWS {since: 2020}]->(b:Person:X {name: 'B'}) RETURN a.name AS a")
    assert out.collect()[0].a == "A" and stats["nodes_created"] == 2 and stats["relationships_created"] == 1
    assert rows(g, "MATCH (a)-[r:KNOWS]->(b:X) RETURN a.age AS x, r.since AS s, b.name AS b") == [(1, 2020, "B")]
    for text, want in (("MERGE (p:Person {name: 'A'}) ON CREATE SET p.n = 1 ON MATCH SET p.n = 2 RETURN p.n AS n", [(2,)]), ("MERGE (p:Person {name: 'C'}) ON CREATE SET p.n = 1 ON MATCH SET p.n = 2 RETURN p.n AS n", [(1,)])):
        g, out, _ = g.write(text)
        assert [tuple(r) for r in out.collect()] == want
    g, _, stats = g.write("UNWIND ['D', 'D', 'C'] AS x MERGE (p:Person {name: x})")
    assert stats["nodes_created"] == 1
    link = "MATCH (a {name: 'A'}), (d {name: 'D'}) MERGE (a)-[r:LIKES]->(d) ON CREATE SET r.k = 1 ON MATCH SET r.k = 2 RETURN r.k AS k"
    for want in (1, 2):
        g, out, _ = g.write(link)
        assert [tuple(r) for r in out.collect()] == [(want,)]
    old = g
    g, _, _ = g.write("MATCH (p:Person) SET p.age = coalesce(p.age, 10) + 1, p:Human")
    g, _, _ = g.write("MATCH (p {name: 'A'}) SET p += {z: 'q'} REMOVE p:Human, p.age")
    assert rows(g, "MATCH (p:Person) RETURN p.name AS n, p.age AS a, p.z AS z, p:Human AS h ORDER BY n") == [("A", None, "q", False), ("B", 11, None, True), ("C", 11, None, True), ("D", 11, None, True)]
    with pytest.raises(CypherError, match="DETACH"):
        g.write("MATCH (p {name: 'B'}) DELETE p")
    g, _, stats = g.write("MATCH (p {name: 'B'}) DETACH DELETE p")
    assert stats["nodes_deleted"] == 1 and stats["relationships_deleted"] == 1
    assert rows(g, "MATCH (p:Person) RETURN count(*) AS n") == [(3,)] and rows(old, "MATCH (p:Person) RETURN count(*) AS n") == [(4,)]


def test_foreach(spark):
    g, _, _ = PropertyGraph(spark).write("FOREACH (x IN [1, 10] | FOREACH (y IN [2, 3] | CREATE (:F {v: x + y})))")
    assert rows(g, "MATCH (n:F) RETURN sum(n.v) AS s") == [(32,)]


@pytest.mark.parametrize(
    ("text", "code"),
    [("CREATE (a)-[:R*2]->(b)", "CreatingVarLength"), ("CREATE (a)-[:R]-(b)", "RequiresDirectedRelationship"), ("CREATE (a)-[:R|S]->(b)", "NoSingleRelationshipType"), ("CREATE (a) CREATE (a:B)", "VariableAlreadyBound"), ("CREATE (a {x: [{y: 1}]})", "InvalidPropertyType"), ("WITH 1 AS x DELETE x", "InvalidDelete")],
)
def test_refused(spark, text, code):
    with pytest.raises(CypherError) as e:
        PropertyGraph(spark).write(text)
    assert e.value.code == code


def test_import_store_and_sink(spark, tmp_path):
    (tmp_path / "n.csv").write_text("id:ID,:LABEL,name,age:int\n1,User,Alice,30\n2,User;Admin,Bob,\n")
    (tmp_path / "r.csv").write_text(":START_ID,:END_ID,:TYPE,since:int\n1,2,FOLLOWS,2024\n")
    g = importer.graph_of(importer.nodes_csv(spark, str(tmp_path / "n.csv")), importer.rels_csv(spark, str(tmp_path / "r.csv")))
    q = "MATCH (a)-[r:FOLLOWS]->(b:Admin) RETURN a.name AS a, a.age AS x, r.since AS s, b.name AS b, b.age AS y"
    assert rows(g, q) == [("Alice", 30, 2024, "Bob", None)]
    at = f"file://{tmp_path}/store"
    assert store.save(g, at) == 1
    g2, _, _ = g.write("MATCH (b:Admin) SET b.age = 5")
    assert store.save(g2, at) == 2 and store.versions(spark, at) == [1, 2]
    assert rows(store.load(spark, at), q)[0][-1] == 5 and rows(store.load(spark, at, 1), q)[0][-1] is None
    assert store.backup(spark, at, f"file://{tmp_path}/copy", 1) == 1
    importer.to_ndjson(g.query(q), f"{tmp_path}/out")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == '{"a":"Alice","x":30,"s":2024,"b":"Bob","y":null}\n'
    (tmp_path / "n.jsonl").write_text('{"id": 1, "label": "U", "properties": {"k": 2}}\n')
    from pyspark.sql import types as T

    assert rows(importer.graph_of(importer.nodes_jsonl(spark, str(tmp_path / "n.jsonl"), T.StructType().add("k", "long"))), "MATCH (u:U) RETURN u.k AS k") == [(2,)]


def test_stream(spark, tmp_path):
    from tessella.streaming.live import windowed_counts

    rows_ = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (3, "2024-01-01 01:10:00", "b", 3.0)], "id long, t string, event_type string, value double").selectExpr("id", "cast(t AS timestamp_ntz) AS ts", "event_type", "value")
    rows_.write.parquet(f"{tmp_path}/ev")
    want = {tuple(r) for r in windowed_counts(rows_).select("event_type", "n", "total").collect()}
    q = windowed_counts(spark.readStream.schema(rows_.schema).parquet(f"{tmp_path}/ev")).writeStream.outputMode("complete").format("memory").queryName("live").start()
    try:
        q.processAllAvailable()
        assert {tuple(r) for r in spark.sql("SELECT event_type, n, total FROM live").collect()} == want == {("a", 2, 3.0), ("b", 1, 3.0)}
    finally:
        q.stop()


def test_merge_takes_rows_in_turn(spark):
    g = PropertyGraph(spark)
    g, out, stats = g.write("UNWIND [1, 1, 1, 2] AS x MERGE (m:M {k: x}) ON CREATE SET m.seen = 1, m.by = x ON MATCH SET m.seen = 2, m.last = x * 10 RETURN x, m.seen AS s, m.last AS l")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 10)] * 3 + [(2, 1, None)] and stats["nodes_created"] == 2
    assert sorted(rows(g, "MATCH (m:M) RETURN m.k AS k, m.seen AS s, m.by AS b")) == [(1, 2, 1), (2, 1, 2)]
    g, _, _ = g.write("MATCH (a:M {k: 1}), (b:M {k: 2}) UNWIND [5, 6] AS w MERGE (a)-[r:TO]->(b) ON CREATE SET r.made = w ON MATCH SET r.met = w, b.hit = w")
    assert rows(g, "MATCH (:M)-[r:TO]->(b) RETURN r.made AS a, r.met AS b, b.hit AS c") == [(5, 6, 6)]
    g, out, stats = g.write("MERGE p = (a:M {k: 9})-[:TO]->(b:M {k: 8}) RETURN length(p) AS n, [x IN nodes(p) | x.k] AS l")
    assert [tuple(r) for r in out.collect()] == [(1, [9, 8])] and stats["nodes_created"] == 2
    g, out, stats = g.write("MERGE (x:Only) ON CREATE SET x.n = 1 ON MATCH SET x.n = 2 RETURN x.n AS n")
    assert out.first().n == 1
    g, out, _ = g.write("MERGE (x:Only) ON CREATE SET x.n = 1 ON MATCH SET x.n = 2 RETURN x.n AS n")
    assert out.first().n == 2


def test_unbounded_hops_are_refused_beyond_the_limit(spark):
    nodes = spark.createDataFrame([(i, ["N"]) for i in range(8)], "id long, labels array<string>")
    rels = spark.createDataFrame([(i, "R", i, i + 1) for i in range(7)], "rid long, type string, src long, dst long")
    g = PropertyGraph.from_frames(spark, nodes, rels)
    q = "MATCH (a:N)-[:R*]->(b) WHERE id(a) = 0 RETURN count(*) AS n"
    assert g.query(q, max_hops=7).first().n == 7
    with pytest.raises(CypherError, match="Hops"):
        g.query(q, max_hops=6)
    loose = PropertyGraph.from_frames(spark, nodes, rels.union(spark.createDataFrame([(99, "R", 0, 77)], rels.schema)), validate=False)
    assert rows(loose, "MATCH (:N)-[r:R]->() RETURN count(r) AS n") == [(7,)]


def test_more_names_than_tables_can_be_are_an_error(spark, monkeypatch):
    from tessella.sources import graph

    monkeypatch.setattr(graph, "MOST_NAMES", 2)
    nodes = spark.createDataFrame([(i, [f"L{i}"]) for i in range(3)], "id long, labels array<string>")
    with pytest.raises(ValueError, match="labels"):
        PropertyGraph.from_frames(spark, nodes)
    rels = spark.createDataFrame([(i, f"T{i}", 0, 1) for i in range(3)], "rid long, type string, src long, dst long")
    with pytest.raises(ValueError, match="types"):
        PropertyGraph.from_frames(spark, nodes.limit(2), rels, validate=False)


def test_command_line(spark, tmp_path, capsys):
    from tessella.sources.database import Database, main

    (tmp_path / "n.csv").write_text("id:ID,:LABEL,name\n1,User,Alice\n9000000000,User,Bob\n")
    (tmp_path / "r.csv").write_text(":START_ID,:END_ID,:TYPE\n1,9000000000,FOLLOWS\n1,9000000000,FOLLOWS\n")
    db = f"file://{tmp_path}/db"
    run = lambda *a: (main([*a, "--db", db], spark), capsys.readouterr().out.strip())[1]
    assert run("import", "--nodes", f"{tmp_path}/n.csv", "--rels", f"{tmp_path}/r.csv") == '{"version": 1}'
    assert run("query", "MATCH (a)-[r]->(b) RETURN b.name AS n, count(DISTINCT id(r)) AS k") == '{"n":"Bob","k":2}'
    assert '"nodes_created": 1' in run("write", "MATCH (a {name: $n}) CREATE (a)-[:KNOWS]->(:User {name: 'C'})", "--params", '{"n": "Alice"}')
    assert run("query", "MATCH (a:User) RETURN count(DISTINCT id(a)) AS n") == '{"n":3}'
    assert run("versions") == "[1, 2]" and run("vacuum") == '{"removed": [1]}' and run("versions") == "[2]"
    d = Database(spark, db)
    with pytest.raises(ZeroDivisionError), d.begin() as t:
        t.write("MATCH (n) DETACH DELETE n")
        raise ZeroDivisionError
    assert rows(d, "MATCH (n) RETURN count(*) AS n") == [(3,)]
    a, b = d.begin(), d.begin()
    a.commit(), a.database
    a.open or b.write("CREATE (:X)")
    b.commit()
    with pytest.raises(ValueError):
        b.commit()


def test_delete_takes_any_number_of_targets(spark):
    nodes = spark.range(2).selectExpr("id", "array('N') AS labels")
    rels = spark.range(100_010).selectExpr("id AS rid", "'R' AS type", "0L AS src", "1L AS dst")
    g = PropertyGraph.from_frames(spark, nodes, rels)
    text = "MATCH (:N)-[r:R]->() WHERE id(r) >= 9 DELETE r"
    less, _, stats = g.write(text)
    assert stats["relationships_deleted"] == 100_001 and rows(less, "MATCH ()-[r:R]->() RETURN count(r) AS n, max(id(r)) AS k") == [(9, 8)]
    none, _, stats = g.write("MATCH (a)-[r]->(b) DELETE r, a, b")
    assert (stats["nodes_deleted"], stats["relationships_deleted"]) == (2, 100_010) and rows(none, "MATCH (n) RETURN count(*) AS n") == [(0,)]
    with pytest.raises(CypherError, match="DeleteLimit"):
        g.write(text, max_deleted=100_000)
