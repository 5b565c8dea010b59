"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import glob
import os
import re
import shutil
from datetime import date, timedelta

import duckdb
import pytest

from tessella.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        out.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return out


def _rows(table):
    one = lambda x: round(x, 6) if isinstance(x, float) else tuple(map(one, x)) if isinstance(x, list) else x
    return sorted(repr(sorted((k, one(x)) for k, x in r.items())) for r in table.to_pylist())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toArrow()
    want = con.sql(SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert _rows(got) == _rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_duration_in_units_at_ends_of_months(spark, tmp_path):
    """Both ways between dates around the ends of months, and null dates, against the SQL."""
    where, own = str(tmp_path / "t"), duckdb.connect()
    shutil.copytree(SF, where)
    days = [date(y, m, 1) + timedelta(k) for y, m in ((2023, 3), (2024, 1), (2024, 2), (2024, 3), (2024, 5), (2025, 3)) for k in range(-4, 3)]
    pairs = [(a, b) for a in days for b in days] + [(None, days[0]), (days[0], None)]
    own.execute("CREATE TABLE pairs (k BIGINT, a DATE, b DATE)")
    own.executemany("INSERT INTO pairs VALUES (?, ?, ?)", [(k, a, b) for k, (a, b) in enumerate(pairs)])
    for name, key, column, day in (("orders", "o_orderkey", "o_orderdate", "a"), ("lineitem", "l_orderkey", "l_shipdate", "b")):
        kind = own.execute(f"SELECT typeof({column}) FROM read_parquet('{SF}/{name}.parquet') LIMIT 1").fetchone()[0]
        own.execute(f"COPY (SELECT t.* REPLACE (k AS {key}, CAST({day} AS {kind}) AS {column}) FROM pairs, (FROM read_parquet('{SF}/{name}.parquet') LIMIT 1) t) TO '{where}/{name}.parquet' (FORMAT parquet)")
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{where}/{name}.parquet')")
    assert _rows(QUERIES["duration_in_units"](spark, where).toArrow()) == _rows(own.sql(SQL["duration_in_units"]).to_arrow_table())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_months_are_added_to_the_first_date(spark):
    """duration.inMonths itself, as in the reference: back from the 29th of February the 31st of January is less than a month away."""
    from tessella.sources.mapping import sales_graph

    months = lambda a, b: f"duration.inMonths(date('{a}'), date('{b}')).months"
    text = f"RETURN {months('2024-02-29', '2024-01-31')} AS a, {months('2024-01-31', '2024-02-29')} AS b, {months('2024-03-31', '2024-02-29')} AS c"
    assert tuple(sales_graph(spark, SF).query(text).collect()[0]) == (0, 1, -1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_bound_relationship_reads_every_row(spark):
    """No limit in the plan that its SQL lacks."""
    plan = QUERIES["bound_relationship"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Limit" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_no_query_picks_rows_by_id():
    """Whole tables: ids are compared in joins and with one given key, never with a range."""
    for name, sql in SQL.items():
        assert name == "cartesian" or not re.search(r"(custkey|partkey|orderkey|suppkey|event_id|doc_id) *(<|<=|>|>=) *[0-9]", sql) or name == "remove_props", name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_hops_are_joined_once(spark):
    """Scans of relationships grow with the hops, not with their square; a node that a relationship's own table tells isn't joined."""
    from tessella.sources.mapping import sales_graph

    def plan(q):
        return sales_graph(spark, SF).query(q)._jdf.queryExecution().optimizedPlan().toString()

    joins = [plan(f"MATCH (a:Turn {{turn: 0}})-[:REPLY*1..{n}]->(b:Turn) RETURN count(*) AS n").count("Join Inner") for n in (2, 4, 8)]
    assert joins[2] <= joins[0] + 7, joins
    assert plan("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 9 RETURN c.c_name AS n, o.o_orderkey AS k").count("Join") == 1
    assert plan("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN c.c_name AS c, n.n_name AS n").count("Join") == 1


def _most_rows(plan):
    """The most rows that an operator of an executed plan put out."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _most_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _most_rows(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if plan.metrics().contains("numOutputRows") else 0
    return max([own] + [_most_rows(plan.children().apply(k)) for k in range(plan.children().size())])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_cycles_do_not_multiply_rows(spark, tmp_path):
    """Many customers and suppliers in a nation: joined by the nation alone they are 223,200 pairs, before any order is read."""
    where, own = str(tmp_path), duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(p)[:-8]
        more = {"customer": "t.* REPLACE (c_custkey + 1000 * k AS c_custkey)", "supplier": "t.* REPLACE (s_suppkey + 1000 * k AS s_suppkey)"}.get(name)
        own.execute(f"COPY (SELECT {more} FROM range(60) r(k), '{p}' t) TO '{where}/{name}.parquet' (FORMAT parquet)" if more else f"COPY (FROM '{p}') TO '{where}/{name}.parquet' (FORMAT parquet)")
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{where}/{name}.parquet')")
    got = QUERIES["expand_cyclic"](spark, where)
    assert sorted(map(tuple, got.collect())) == sorted(own.sql(SQL["expand_cyclic"]).fetchall())
    assert 6_000 <= _most_rows(got._jdf.queryExecution().executedPlan()) < 20_000


CYCLE = "(c:Customer)-[:LIVES_IN]->(n:Nation)<-[:BASED_IN]-(s:Supplier), (c)-[:PLACED]->(:Order)-[:CONTAINS]->(p:Part)<-[:SHIPPED]-(s)"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize(
    "text",
    [
        f"MATCH {CYCLE} RETURN c.c_name AS c, s.s_name AS s, p.p_name AS p, n.n_name AS n",
        f"MATCH (s), (r:Region), {CYCLE} WHERE r.r_regionkey < 2 RETURN r.r_name AS r, s.s_suppkey AS s, count(*) AS n",
        "MATCH (c)-[a:PLACED]->(o), (o)-[l:CONTAINS]->(p:Part)<-[k:CONTAINS]-(q:Order)<-[b:PLACED]-(c:Customer) RETURN id(a) AS a, id(b) AS b, id(l) AS l, id(k) AS k, type(k) AS t",
        "MATCH (c)-[:LIVES_IN]->(n:Nation {n_nationkey: 3})<-[:BASED_IN]-(s), (c)-[:PLACED]->()-[l:CONTAINS {l_linenumber: 1}]->()<-[:SHIPPED]-(s) RETURN c.c_custkey AS c, s.s_suppkey AS s, l.l_quantity AS q",
        "MATCH (n)<-[:LIVES_IN]-(c), (n)<-[:BASED_IN]-(s), (c)-[:PLACED]->()-[:CONTAINS]->(p)-[:SHIPPED]-(s:Party) RETURN n.n_name AS n, count(DISTINCT p) AS p",
        f"MATCH (c:Customer) WHERE c.c_custkey < 60 OPTIONAL MATCH {CYCLE} RETURN c.c_custkey AS c, count(s) AS n",
        f"MATCH (s:Supplier) WHERE EXISTS {{ {CYCLE} }} RETURN s.s_suppkey AS s",
    ],
)
def test_cycles_in_pieces_are_those_walked_as_written(spark, monkeypatch, text):
    from tessella.cypher.compile import Compiler
    from tessella.sources.mapping import sales_graph

    g, pieces = sales_graph(spark, SF), Compiler._pieces
    found = []
    monkeypatch.setattr(Compiler, "_pieces", lambda *a: found.append(pieces(*a)) or found[-1])
    got = sorted(map(repr, g.query(text).collect()))
    assert any(len(x) == 2 for x in found) and got
    monkeypatch.setattr(Compiler, "_pieces", lambda *a: [])
    assert got == sorted(map(repr, g.query(text).collect()))
