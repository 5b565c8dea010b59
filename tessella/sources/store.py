"""Graph versions on shared storage: a folder for each, and backups of them.

A version is complete once its manifest, written last, is there; readers take the newest complete
one, so a lost writer leaves nothing that is read.  Paths go through Spark's own file systems.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from .graph import NodeTable, PropertyGraph, RelTable


def _labels(x: frozenset | None) -> list | None:
    return None if x is None else sorted(x)


def save(graph: PropertyGraph, path: str) -> int:
    """Writes a new version; returns its number."""
    n = max(versions(graph.spark, path), default=0) + 1
    at = f"{path}/v{n:08d}"
    manifest = {"next_id": graph.next_id, "slots": graph.slots, "nodes": [], "rels": []}
    for k, t in enumerate(graph.nodes):
        t.df.write.parquet(f"{at}/nodes-{k}")
        manifest["nodes"].append({"always": _labels(t.always), "maybe": _labels(t.maybe)})
    for k, r in enumerate(graph.rels):
        r.df.drop(*[x for x in r.df.columns if x.startswith("_at_")]).write.parquet(f"{at}/rels-{k}")
        manifest["rels"].append({"type": r.type, "src": _labels(r.src), "dst": _labels(r.dst)})
    graph.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{at}/manifest")
    return n


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of complete versions."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/manifest/_SUCCESS")))


def load(spark: SparkSession, path: str, version: int | None = None) -> PropertyGraph:
    found = versions(spark, path)
    if not found or version is not None and version not in found:
        raise ValueError(f"no such version in {path}")
    at = f"{path}/v{version or found[-1]:08d}"
    m = json.loads(spark.read.text(f"{at}/manifest").first()[0])
    frozen = lambda x: None if x is None else frozenset(x)
    g = PropertyGraph(spark, next_id=m["next_id"], slots=m["slots"])
    g.nodes = [NodeTable(spark.read.parquet(f"{at}/nodes-{k}"), frozen(t["always"]), frozen(t["maybe"])) for k, t in enumerate(m["nodes"])]
    g.rels = [RelTable(spark.read.parquet(f"{at}/rels-{k}"), r["type"], frozen(r["src"]), frozen(r["dst"])) for k, r in enumerate(m["rels"])]
    return g


def backup(spark: SparkSession, path: str, to: str, version: int | None = None) -> int:
    """Copies a version to another place as its next one."""
    return save(load(spark, path, version), to)


def restore(spark: SparkSession, backup_path: str, path: str, version: int | None = None) -> int:
    """A version of a backup as the newest one of a store; the store's own versions stay."""
    return save(load(spark, backup_path, version), path)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Removes all but the newest `keep` complete versions, and what lost writers left below them; returns their numbers.

    A graph that was loaded from a removed version can't be read any more."""
    if keep < 1:
        raise ValueError("the newest version stays")
    done = versions(spark, path)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not done:
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
    gone = [n for n in found if n < done[-1] and n not in done[-keep:]]
    for n in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/v{n:08d}"), True)
    return gone
