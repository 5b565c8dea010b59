"""Property graphs over ordinary tables.

A node table has columns _id (unique in the graph), _labels and its properties; a relationship
table _rid, _src, _dst and its properties.  Ids of registered tables are key * 64 + table number, so
keys of several tables may collide; the key stays as a property.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOTS = 64
MOST_NAMES = 10_000
_KINDS = {T.ByteType: "long", T.ShortType: "long", T.IntegerType: "long", T.FloatType: "double", T.DecimalType: "double", T.CharType: "string", T.VarcharType: "string"}


def plain_types(df: DataFrame) -> DataFrame:
    """Whole numbers as LONG, fractions as DOUBLE."""
    return df.select(*[F.col(f"`{f.name}`").cast(_KINDS[type(f.dataType)]).alias(f.name) if type(f.dataType) in _KINDS else F.col(f"`{f.name}`") for f in df.schema.fields])


@dataclass(frozen=True)
class NodeTable:
    df: DataFrame
    always: frozenset  # labels that each row has
    maybe: frozenset  # labels that a row may have

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields if f.name not in ("_id", "_labels")}


@dataclass(frozen=True)
class RelTable:
    df: DataFrame
    type: str
    src: frozenset | None = None  # labels of which a source has one; None: any node
    dst: frozenset | None = None
    carried: tuple = ()  # (src or dst, node table, its labels): the rows have that node's properties as _at_src_... or _at_dst_...
    derived: bool = False  # made by more than a scan: written once where it is read

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields if f.name not in ("_rid", "_src", "_dst") and not f.name.startswith("_at_")}


@dataclass
class PropertyGraph:
    spark: SparkSession
    nodes: list[NodeTable] = field(default_factory=list)
    rels: list[RelTable] = field(default_factory=list)
    procedures: dict = field(default_factory=dict)
    slots: dict = field(default_factory=dict)
    next_id: int = 0  # for created nodes and relationships
    made: dict = field(default_factory=dict)  # id of a derived table: (it, its rows as written)

    # --- registration

    def _slot(self, name: str) -> int:
        if name not in self.slots:
            if len(self.slots) >= SLOTS - 1:
                raise ValueError(f"at most {SLOTS - 1} registered tables")
            self.slots[name] = len(self.slots)
        return self.slots[name]

    def _id(self, label: str, key: str | Column) -> Column:
        return (F.col(key) if isinstance(key, str) else key).cast("long") * SLOTS + self.slots[label]

    def add_nodes(self, label: str, df: DataFrame, key: str | Column, more: tuple[str, ...] = ()) -> PropertyGraph:
        """A table of nodes with one label, or several with `more`."""
        self._slot(label)
        rows = plain_types(df)
        labels = (label, *more)
        out = rows.select(self._id(label, key).alias("_id"), F.array(*map(F.lit, labels)).alias("_labels"), *[F.col(f"`{c}`") for c in rows.columns])
        self.nodes.append(NodeTable(out, frozenset(labels), frozenset(labels)))
        return self

    def add_rels(self, kind: str, df: DataFrame, src: tuple[str, str | Column], dst: tuple[str, str | Column], rid: str | Column, props: tuple[str, ...] = (), holds: str | None = None, derived: bool = False) -> PropertyGraph:
        """(src label)-[kind]->(dst label); rid is unique in the table.

        holds (src or dst): df is the very table that the nodes of that end were registered from, so their
        properties are read with the relationship and not by a join."""
        slot = self._slot(f":{kind}:{src[0]}:{dst[0]}")
        out = plain_types(df.select(
            ((F.col(rid) if isinstance(rid, str) else rid).cast("long") * SLOTS + slot).alias("_rid"), self._id(src[0], src[1]).alias("_src"), self._id(dst[0], dst[1]).alias("_dst"), *[F.col(f"`{p}`") for p in props],
            *([F.col(f"`{x}`").alias(f"_at_{holds}_{x}") for x in df.columns] if holds else []),
        ))
        label = {"src": src, "dst": dst}[holds][0] if holds else None
        carried = tuple((holds, n, tuple(sorted(n.always, key=lambda x: x != label))) for n in self.nodes if label in n.always) if holds else ()
        self.rels.append(RelTable(out, kind, frozenset([src[0]]), frozenset([dst[0]]), carried if len(carried) == 1 else (), derived))
        return self

    @classmethod
    def from_frames(cls, spark: SparkSession, nodes: DataFrame, rels: DataFrame | None = None, validate: bool = True) -> PropertyGraph:
        """From frames (id, labels, properties...) and (rid, type, src, dst, properties...).

        Labels and types are at most MOST_NAMES each, as each type is a table of the plan; more are an error.
        validate: node ids given twice and ends that are no node are errors.  Else ids are taken as unique, and
        relationships without both ends are left out as they are read."""
        g = cls(spark)
        nodes = plain_types(nodes)
        names = frozenset(r[0] for r in nodes.select(F.explode("labels")).distinct().limit(MOST_NAMES + 1).collect())
        if len(names) > MOST_NAMES:
            raise ValueError(f"more than {MOST_NAMES} labels")
        g.nodes.append(NodeTable(nodes.select(F.col("id").alias("_id"), F.col("labels").alias("_labels"), *[c for c in nodes.columns if c not in ("id", "labels")]), frozenset(), names))
        top = nodes.agg(F.max("id")).first()[0]
        if rels is not None:
            rels = plain_types(rels)
            if validate:
                ends = rels.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
                if not ends.join(nodes, "id", "left_anti").isEmpty():
                    raise ValueError("a relationship's end is missing")
            else:
                for end in ("src", "dst"):
                    rels = rels.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
            kinds = sorted(rels.select("type").distinct().limit(MOST_NAMES + 1).collect())
            if len(kinds) > MOST_NAMES:
                raise ValueError(f"more than {MOST_NAMES} relationship types")
            for (kind,) in kinds:
                g.rels.append(RelTable(rels.where(F.col("type") == kind).select(F.col("rid").alias("_rid"), F.col("src").alias("_src"), F.col("dst").alias("_dst"), *[c for c in rels.columns if c not in ("rid", "src", "dst", "type")]), kind))
            top = max(top or 0, rels.agg(F.max("rid")).first()[0] or 0)
        if validate and nodes.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("a node id is given twice")
        g.next_id = (top // SLOTS if top is not None else -1) + 1  # created ids are this times SLOTS and more
        return g

    def register_procedure(self, name: str, inputs: list[str], outputs: dict[str, T.DataType], run) -> PropertyGraph:
        """run(*argument columns) -> a column of ARRAY<STRUCT> with the outputs; each row of it becomes one."""
        self.procedures[name.lower()] = (inputs, outputs, run)
        return self

    # --- reading

    def rel_frame(self, r: RelTable) -> DataFrame:
        """A relationship table's rows; derived ones are written to the shared folder when they are first read."""
        if not r.derived:
            return r.df
        if id(r) not in self.made:
            from .shared import written

            self.made[id(r)] = (r, written(r.df, "relationships"))
        return self.made[id(r)][1]

    def create_index(self, label: str, prop: str) -> PropertyGraph:
        """A graph whose nodes of a label lie sorted by a property, so that scans skip row groups by their ranges.

        Each table that may hold the label is written once, range-partitioned and sorted."""
        from .shared import written

        tables = [replace(n, df=written(n.df.repartitionByRange(F.col(f"`{prop}`")).sortWithinPartitions(f"`{prop}`"), "index")) if label in n.maybe and prop in n.props else n for n in self.nodes]
        return replace(self, nodes=tables)

    def node_tables(self, labels: tuple[str, ...]) -> list[NodeTable]:
        return [n for n in self.nodes if set(labels) <= n.maybe]

    def statistics(self) -> dict[str, dict[str, int]]:
        """Node counts by label and relationship counts by type; one row for each on the driver."""
        nodes: dict[str, int] = {}
        for n in self.nodes:
            for label, count in n.df.select(F.explode("_labels").alias("l")).groupBy("l").count().collect():
                nodes[label] = nodes.get(label, 0) + count
        rels: dict[str, int] = {}
        for r in self.rels:
            rels[r.type] = rels.get(r.type, 0) + r.df.count()
        return {"nodes": nodes, "relationships": rels}

    def query(self, text: str, params: dict | None = None, **options) -> DataFrame:
        """The rows of a reading query."""
        from ..cypher.compile import run_query

        return run_query(self, text, params or {}, **options)

    def write(self, text: str, params: dict | None = None, **options):
        """(new graph, rows or None, counts) of an updating query; this graph stays as it is."""
        from ..cypher.updates import run_update

        return run_update(self, text, params or {}, **options)

    def explain(self, text: str, params: dict | None = None) -> str:
        return self.query(text, params)._jdf.queryExecution().toString()

    def knn(self, label: str, prop: str, query: list[float], k: int) -> DataFrame:
        """id and distance of the k nodes with a label whose vectors are nearest."""
        from ..operators.vector import knn

        tables = [n for n in self.node_tables((label,)) if prop in n.props]
        rows = None
        for n in tables:
            part = n.df.where(F.array_contains("_labels", label)).select("_id", F.col(f"`{prop}`").cast("array<double>").alias(prop))
            rows = part if rows is None else rows.union(part)
        if rows is None:
            rows = self.spark.createDataFrame([], T.StructType().add("_id", "long").add(prop, "array<double>"))
        return knn(rows.where(F.col(f"`{prop}`").isNotNull()), "_id", prop, query, k)
