"""A graph with transactions, kept in a versioned store, and its command line.

python -m tessella query|write|explain|import|versions|vacuum|backup --db FOLDER ...
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from . import importer, store
from .graph import PropertyGraph


class Transaction:
    """Writes see each other at once; the database sees them after commit, and never after rollback."""

    def __init__(self, database: Database):
        self.database, self.graph, self.started_from, self.open = database, database.graph, database.graph, True
        self.counts: dict[str, int] = {}

    def query(self, text: str, params: dict | None = None, **options) -> DataFrame:
        return self.graph.query(text, params, **options)

    def write(self, text: str, params: dict | None = None, **options) -> DataFrame | None:
        if not self.open:
            raise ValueError("the transaction has ended")
        self.graph, rows, counts = self.graph.write(text, params, **options)
        self.counts = {k: self.counts.get(k, 0) + n for k, n in counts.items()}
        return rows

    def commit(self) -> dict[str, int]:
        if not self.open:
            raise ValueError("the transaction has ended")
        if self.database.graph is not self.started_from:
            raise ValueError("another transaction was committed since this one began")
        self.open, self.database.graph = False, self.graph
        return self.counts

    def rollback(self) -> None:
        self.open = False

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.open:
            self.commit() if kind is None else self.rollback()


class Database:
    """The newest version of a folder, or an empty graph; save writes a new version."""

    def __init__(self, spark: SparkSession, path: str | None = None, graph: PropertyGraph | None = None):
        self.spark, self.path = spark, path
        self.graph = graph or (store.load(spark, path) if path and store.versions(spark, path) else PropertyGraph(spark))

    def query(self, text: str, params: dict | None = None, **options) -> DataFrame:
        return self.graph.query(text, params, **options)

    def begin(self) -> Transaction:
        return Transaction(self)

    def save(self) -> int:
        if self.path is None:
            raise ValueError("a database without a folder")
        return store.save(self.graph, self.path)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessella")
    p.add_argument("command", choices=("query", "write", "explain", "import", "versions", "vacuum", "backup"))
    p.add_argument("text", nargs="?", help="a Cypher query")
    p.add_argument("--db", required=True)
    p.add_argument("--params", default="{}", help="a JSON object")
    p.add_argument("--format", choices=("csv", "jsonl"), default="csv")
    p.add_argument("--nodes")
    p.add_argument("--rels")
    p.add_argument("--keep", type=int, default=1)
    p.add_argument("--to")
    a = p.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("tessella").getOrCreate()
    if a.command == "import":
        read = (importer.nodes_csv, importer.rels_csv) if a.format == "csv" else (importer.nodes_jsonl, importer.rels_jsonl)
        graph = importer.graph_of(read[0](spark, a.nodes), read[1](spark, a.rels) if a.rels else None)
        print(json.dumps({"version": store.save(graph, a.db)}))
        return 0
    if a.command == "versions":
        print(json.dumps(store.versions(spark, a.db)))
        return 0
    if a.command == "vacuum":
        print(json.dumps({"removed": store.vacuum(spark, a.db, a.keep)}))
        return 0
    if a.command == "backup":
        print(json.dumps({"version": store.backup(spark, a.db, a.to)}))
        return 0
    database, params = Database(spark, a.db), json.loads(a.params)
    if a.command == "write":
        with database.begin() as t:
            rows = t.write(a.text, params)
        counts = t.counts | {"version": database.save()}
        _print(rows)
        print(json.dumps(counts))
    else:
        _print(database.query(("EXPLAIN " if a.command == "explain" else "") + a.text, params))
    return 0


def _print(rows: DataFrame | None) -> None:
    """A JSON object a line, one partition at a time."""
    for r in importer.as_json(rows).toLocalIterator() if rows is not None else ():
        print(r.json)
