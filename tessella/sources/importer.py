"""Typed bulk import of CSV and JSON lines, and the NDJSON sink.

CSV headers: `id:ID` or `:ID`, `:LABEL`, `name[:int|float|bool|string]` for nodes; `:START_ID`,
`:END_ID`, `:TYPE` and properties for relationships.  Empty cells are absent values.  JSON lines:
{"id", "label", "properties"} and {"src", "dst", "type", "properties"}.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import PropertyGraph
from .shared import numbered

_KINDS = {"int": "bigint", "long": "bigint", "integer": "bigint", "float": "double", "double": "double", "bool": "boolean", "boolean": "boolean", "string": "string", "str": "string"}


def _cell(column: str, kind: str) -> Column:
    raw = F.nullif(F.col(f"`{column}`"), F.lit(""))
    if kind == "boolean":
        low = F.lower(raw)
        return F.when(low == "true", True).when(low == "false", False).when(low.isNotNull(), F.raise_error(F.concat(F.lit("not a Boolean: "), low)).cast("boolean"))
    return raw.cast(kind)  # a cell that doesn't fit its type is an error


def _header(names: list[str], special: dict[str, str]) -> tuple[dict[str, str], list[tuple[str, str, str]]]:
    """(special columns by role, properties as (column, name, kind))."""
    roles, props = {}, []
    for n in names:
        name, _, kind = n.partition(":")
        if kind.upper() in special and special[kind.upper()] not in roles:
            roles[special[kind.upper()]] = n
        elif not kind or kind.lower() in _KINDS:
            props.append((n, name, _KINDS[kind.lower() or "string"]))
        else:
            raise ValueError(f"unknown type in header column {n}")
    if missing := [k for k, r in special.items() if r not in roles]:
        raise ValueError(f"header lacks :{missing[0]}")
    return roles, props


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=False)


def nodes_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path)
    roles, props = _header(rows.columns, {"ID": "id", "LABEL": "label"})
    labels = F.filter(F.split(F.col(f"`{roles['label']}`"), ";"), lambda x: x != "")
    return rows.select(F.col(f"`{roles['id']}`").cast("long").alias("id"), labels.alias("labels"), *[_cell(c, k).alias(n) for c, n, k in props])


def rels_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path)
    roles, props = _header(rows.columns, {"START_ID": "src", "END_ID": "dst", "TYPE": "type"})
    fixed = [F.col(f"`{roles['type']}`").alias("type"), *[F.col(f"`{roles[r]}`").cast("long").alias(r) for r in ("src", "dst")]]
    return rows.select(*fixed, *[_cell(c, k).alias(n) for c, n, k in props])


def _properties(spark: SparkSession, path: str) -> T.StructType:
    """The types of all properties in a file of JSON lines, by reading it."""
    found = spark.read.option("mode", "FAILFAST").json(path).schema
    inner = found["properties"].dataType if "properties" in found.fieldNames() else None
    return inner if isinstance(inner, T.StructType) else T.StructType()


def nodes_jsonl(spark: SparkSession, path: str, properties: T.StructType | None = None) -> DataFrame:
    properties = properties or _properties(spark, path)
    schema = T.StructType().add("id", "long").add("label", "string").add("properties", properties)
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.select("id", F.array("label").alias("labels"), *[F.col(f"properties.`{f.name}`") for f in properties.fields])


def rels_jsonl(spark: SparkSession, path: str, properties: T.StructType | None = None) -> DataFrame:
    properties = properties or _properties(spark, path)
    schema = T.StructType().add("src", "long").add("dst", "long").add("type", "string").add("properties", properties)
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.select("type", "src", "dst", *[F.col(f"properties.`{f.name}`") for f in properties.fields])


def graph_of(nodes: DataFrame, rels: DataFrame | None = None) -> PropertyGraph:
    """Checks that ids are unique and ends exist, as bulk loads do.  Relationships are numbered from 0 on and written first."""
    if rels is not None:
        rels = numbered(rels, "import")[0].withColumnRenamed("_row", "rid")
    return PropertyGraph.from_frames(nodes.sparkSession, nodes, rels, validate=True)


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON object, nulls kept, in column `json`."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("json"))


def to_ndjson(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept."""
    rows.write.option("ignoreNullFields", "false").mode("errorifexists").json(path)
