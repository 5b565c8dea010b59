"""Updating clauses: each makes a new version of the graph's tables; the old graph stays.

The rows that a clause works on are written to the shared folder with dense row numbers first, so
new ids and repeated reads are stable however often a task is run.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as v
from ..functions.values import NULL, STRING, Val
from ..sources.graph import SLOTS, NodeTable, PropertyGraph, RelTable
from ..sources.shared import numbered, written
from . import tree as t
from .compile import Compiler, NodeB, RelB, ValB, c
from .errors import CypherError
from .parser import parse


def _settled_id(n: Column) -> Column:
    """Created things take the last slot, which no registered table has."""
    return n * SLOTS + (SLOTS - 1)


class Updater(Compiler):
    """A compiler whose graph changes from clause to clause."""

    def __init__(self, graph: PropertyGraph, params: dict, counter=None, options: dict | None = None, moved: dict | None = None):
        self.moved = {} if moved is None else moved  # id of a node table: (it, the one that took its place)
        super().__init__(replace(graph, nodes=list(graph.nodes), rels=list(graph.rels)), params, counter, options)
        self.stats = dict.fromkeys(("nodes_created", "relationships_created", "properties_set", "labels_added", "labels_removed", "nodes_deleted", "relationships_deleted"), 0)

    def child(self) -> Compiler:
        return Compiler(self.graph, self.params, self.counter, self.options)

    def update(self, k: Any) -> None:
        if self.unit:
            self.unit = False
        {t.Create: self.create, t.Merge: self.merge, t.Set: self.set, t.Remove: self.remove, t.Delete: self.delete, t.Foreach: self.foreach}[type(k)](k)

    # --- rows --------------------------------------------------------------------------------

    def _settle(self) -> int:
        """Rows as a written, numbered table."""
        self.frame, n = numbered(self.frame.drop("_row"), "rows")
        return n

    def _fresh_ids(self, n: int) -> int:
        first = self.graph.next_id
        self.graph.next_id += n
        return first

    def _values(self, props: Any) -> dict[str, Val]:
        if props is None:
            return {}
        if isinstance(props, t.Param):
            return {k: v.lit(x) for k, x in (self.params.get(props.name) or {}).items()}
        for _, e in props.items:
            self.prepare(e)
        out = {k: self.ev(e) for k, e in props.items}
        for k, x in out.items():
            _storable(k, x)
        return {k: x for k, x in out.items() if x.type != NULL}

    # --- tables ------------------------------------------------------------------------------

    def _add_nodes(self, rows: DataFrame, labels: tuple, props: dict[str, T.DataType]) -> NodeTable:
        table = NodeTable(rows, frozenset(labels), frozenset(labels))
        self.graph.nodes.append(table)
        return table

    def _latest(self, table: NodeTable) -> NodeTable:
        while id(table) in self.moved:
            table = self.moved[id(table)][1]
        return table

    def _move(self, i: int, new: NodeTable) -> None:
        old = self.graph.nodes[i]
        self.moved[id(old)] = (old, new)
        self.graph.nodes[i] = new

    def _own(self, tables: tuple) -> set[int]:
        """Places in the graph of a variable's tables."""
        ids = {id(self._latest(n)) for n in tables}
        return {i for i, n in enumerate(self.graph.nodes) if id(n) in ids}

    def _rebind(self) -> None:
        """Variables look into the graph as it is now."""
        for n, b in list(self.scope.items()):
            if isinstance(b, NodeB):
                if b.props is not None:
                    gone = [x for x in b.columns if x != b.id]
                    self.frame = self.frame.drop(*gone)
                self.scope[n] = NodeB(b.prefix, tuple(dict.fromkeys(map(self._latest, b.tables))), nullable=True)
            elif isinstance(b, RelB):
                self.frame = self.frame.drop(*[x for x in b.columns if x not in (b.key, f"{b.prefix}__type", f"{b.prefix}__src", f"{b.prefix}__dst")])
                rows, made, _, _ = self._rel_rows([(r, True) for r in self.graph.rels if r.type in b.types], b.prefix, False)
                rows = rows.select(c(b.key).alias(f"{b.prefix}__k"), *[c(f"{b.prefix}_p_{p}") for p in made.props])
                self.frame = self.frame.join(rows, c(b.key) == c(f"{b.prefix}__k"), "left").drop(f"{b.prefix}__k")
                self.scope[n] = replace(b, props=made.props, src=tuple(map(self._latest, b.src)), dst=tuple(map(self._latest, b.dst)))

    # --- CREATE ------------------------------------------------------------------------------

    def create(self, k: t.Create) -> None:
        for p in k.patterns:
            self._check_create(p, merge=False)
        rows = self._settle()
        for p in k.patterns:
            self._create_path(p, rows)

    def _check_create(self, p: t.PathPattern, merge: bool) -> None:
        for x in p.parts:
            if isinstance(x, t.NodePattern):
                if x.var in self.scope and (x.labels or x.props or len(p.parts) == 1):
                    raise CypherError("VariableAlreadyBound", x.var)
            else:
                if x.hops is not None:
                    raise CypherError("CreatingVarLength")
                if x.way == "both" and not merge:
                    raise CypherError("RequiresDirectedRelationship")
                if len(x.types) != 1:
                    raise CypherError("NoSingleRelationshipType")
                if x.var in self.scope:
                    raise CypherError("VariableAlreadyBound", x.var)

    def _create_path(self, p: t.PathPattern, rows: int) -> None:
        parts = [replace(x, var=x.var or f" {self.fresh()}") for x in p.parts]
        for x in parts[::2]:
            if x.var not in self.scope:
                self._create_node(x, rows)
        for a, r, b in zip(parts[::2], parts[1::2], parts[2::2]):
            self._create_rel(a, r, b, rows)
        if p.var:
            self._name_path(p.var, parts[::2], {k: ("one", r.var) for k, r in enumerate(parts[1::2])})

    def _create_node(self, x: t.NodePattern, rows: int) -> None:
        values = self._values(x.props)
        first, prefix = self._fresh_ids(rows), self.fresh()
        self.frame = self.frame.withColumn(f"{prefix}__id", _settled_id(F.col("_row") + first))
        # the rows are a written table, so the new table reads them again rather than running the query twice
        made = self.frame.select(c(f"{prefix}__id").alias("_id"), F.array(*map(F.lit, x.labels)).cast("array<string>").alias("_labels"), *[q.col.alias(n) for n, q in values.items()])
        table = self._add_nodes(made, x.labels, {})
        self.scope[x.var] = NodeB(prefix, (table,))
        self.stats["nodes_created"] += rows
        self.stats["properties_set"] += rows * len(values)
        self.stats["labels_added"] += rows * len(set(x.labels))

    def _create_rel(self, a: t.NodePattern, r: t.RelPattern, b: t.NodePattern, rows: int) -> None:
        values = self._values(r.props)
        first, prefix = self._fresh_ids(rows), self.fresh()
        src, dst = (a, b) if r.way != "in" else (b, a)
        s, d = self.scope[src.var], self.scope[dst.var]
        self.frame = self.frame.withColumns({
            f"{prefix}__rid": _settled_id(F.col("_row") + first), f"{prefix}__type": F.lit(r.types[0]), f"{prefix}__src": c(s.id), f"{prefix}__dst": c(d.id), **{f"{prefix}_p_{n}": q.col for n, q in values.items()}
        })
        made = self.frame.select(c(f"{prefix}__rid").alias("_rid"), c(s.id).alias("_src"), c(d.id).alias("_dst"), *[c(f"{prefix}_p_{n}").alias(n) for n in values])
        self.graph.rels.append(RelTable(made, r.types[0]))
        self.scope[r.var] = RelB(prefix, r.types, {n: q.type for n, q in values.items()}, src=tuple(self.graph.nodes), dst=tuple(self.graph.nodes))
        self.stats["relationships_created"] += rows
        self.stats["properties_set"] += rows * len(values)

    # --- MERGE -------------------------------------------------------------------------------

    def merge(self, k: t.Merge) -> None:
        """Rows are taken in turn for each thing to merge: the first row of one that is missing creates it, and every
        other row matches.  A row's ON MATCH reads what stood before any row's ON MATCH of this clause."""
        p = k.pattern
        if len(p.parts) not in (1, 3):
            raise CypherError("NotSupported", "MERGE of more than one relationship", "execution")
        self._check_create(p, merge=True)
        parts = [replace(x, var=x.var or f" {self.fresh()}") for x in p.parts]
        new_names = [x.var for x in parts if x.var not in self.scope]
        values = {}
        for x in parts:
            for key, e in (x.props.items if isinstance(x.props, t.MapOf) else ()):
                self.prepare(e)
                q = self.ev(e)
                _storable(key, q)
                column = self.fresh()
                values[(x.var, key)] = (column, q.type)
                self.frame = self.frame.withColumn(column, q.col)
        bound = [self.scope[x.var].id for x in parts[::2] if x.var in self.scope]
        keys = list(dict.fromkeys(bound + [n for n, _ in values.values()]))
        if not keys:
            keys = [self.fresh()]
            self.frame = self.frame.withColumn(keys[0], F.lit(True))
        self._settle()
        first, into = self.fresh(), {n: self.fresh() for n in new_names}
        want = written(self.frame.groupBy(*map(c, keys)).agg(F.min("_row").alias(first)), "wanted")
        spots = {n: f" {n}" for n, _ in values.values()}
        asked = tuple(replace(x, props=t.MapOf(tuple((key, t.Var(spots[values[(x.var, key)][0]])) for key, _ in x.props.items)) if isinstance(x.props, t.MapOf) else x.props) for x in parts)
        given = {x.var: self.scope[x.var] for x in parts[::2] if x.var in self.scope} | {spots[n]: ValB(n, kind) for n, kind in values.values()}

        def columns(scope: dict) -> list[Column]:
            return [c(f"{scope[n].prefix}__{x}").alias(f"{name}__{x}") for n, name in into.items() for x in (("id",) if isinstance(scope[n], NodeB) else ("rid", "type", "src", "dst"))]

        old = Compiler(self.graph, self.params, self.counter, self.options)
        old.frame, old.unit, old.scope = want, False, dict(given)
        old.match_patterns((t.PathPattern(None, None, asked),))
        found = written(old.frame.select(*map(c, keys), F.lit(None).cast("long").alias(first), *columns(old.scope)), "matched")

        def same(other: str = "k_") -> Column:
            on = F.lit(True)
            for x in keys:
                on = on & c(x).eqNullSafe(c(f"{other}{x}"))
            return on

        missing = want.join(found.select(*[c(x).alias(f"k_{x}") for x in keys]).distinct(), same(), "left_anti")
        maker = Updater(self.graph, self.params, self.counter, self.options, self.moved)
        maker.unit, maker.scope = False, dict(given)
        if k.on_create:  # the creating row's variables are there
            missing = self.frame.join(missing.select(first), c("_row") == c(first))
            maker.scope = self.scope | maker.scope
        maker.frame = missing
        if made := maker._settle():
            new = tuple(replace(x, way="out" if x.way == "both" else x.way) if isinstance(x, t.RelPattern) else replace(x, labels=() if x.var in self.scope else x.labels) for x in asked)
            maker._create_path(t.PathPattern(None, None, new), made)
            found = found.unionByName(maker.frame.select(*map(c, keys), c(first), *columns(maker.scope)))
            if k.on_create:
                maker.set(t.Set(k.on_create))
            self._took(maker)
        for n, name in into.items():
            x = next(x for x in parts if x.var == n)
            self.scope[n] = NodeB(name, tuple(self.graph.node_tables(x.labels))) if isinstance(x, t.NodePattern) else RelB(name, tuple(x.types), {}, src=tuple(self.graph.nodes), dst=tuple(self.graph.nodes))
        self.frame = self.frame.join(found.withColumnsRenamed({x: f"k_{x}" for x in keys}), same()).drop(*[f"k_{x}" for x in keys])
        if k.on_match:
            setter = Updater(self.graph, self.params, self.counter, self.options, self.moved)
            setter.frame, setter.unit, setter.scope = self.frame.where(c(first).isNull() | (c(first) != c("_row"))), False, dict(self.scope)
            setter._rebind()
            setter.prepare(*[i.value for i in k.on_match if i.kind != "labels"])
            setter.frame = written(setter.frame, "merged")
            for item in k.on_match:
                setter._set_one(item, remove=False)
            self._took(setter)
        self.frame = self.frame.drop(first, *[n for n, _ in values.values()])
        self._rebind()
        if p.var:
            self._name_path(p.var, parts[::2], {0: ("one", parts[1].var)} if len(parts) == 3 else {})

    def _took(self, other: Updater) -> None:
        self.graph = other.graph
        for n, x in other.stats.items():
            self.stats[n] += x

    # --- SET and REMOVE ----------------------------------------------------------------------

    def set(self, k: t.Set) -> None:
        self.prepare(*[i.value for i in k.items if i.kind != "labels"])
        self._settle()
        for item in k.items:
            self._set_one(item, remove=False)
        self._rebind()

    def remove(self, k: t.Remove) -> None:
        self._settle()
        for item in k.items:
            self._set_one(item, remove=True)
        self._rebind()

    def _set_one(self, item: t.SetItem, remove: bool) -> None:
        b = self.binding(item.var)
        if not isinstance(b, (NodeB, RelB)):
            raise CypherError("InvalidArgumentType", item.var)
        if item.kind == "labels":
            if isinstance(b, RelB):
                raise CypherError("InvalidArgumentType", "labels of a relationship")
            self._change_labels(b, item.value, remove)
            return
        if item.kind == "property":
            x = v.null() if item.value is None else self.ev(item.value)
            _storable(item.key, x)
            values, whole = {item.key: x}, False
        else:
            x = self.ev(item.value)
            whole = item.kind == "replace"
            if x.type == NULL:
                return
            if not v.is_map(x.type):
                raise CypherError("InvalidArgumentType", "SET takes a map")
            names = [n for n in (x.fields or x.type.fieldNames()) if not n.startswith("_")]
            values = {n: (x.fields[n] if x.fields else Val(x.col[n], x.type[n].dataType)) for n in names}
            for n, y in values.items():
                _storable(n, y)
        key = F.col(f"`{b.key}`")
        # of several rows for one thing the last row decides
        news = self.frame.where(key.isNotNull()).groupBy(key.alias("_k")).agg(*[F.max_by(F.struct((x.col.cast("string") if x.type == NULL else x.col).alias("x")), F.col("_row")).alias(f"_n{i}") for i, x in enumerate(values.values())], F.count(F.lit(1)).alias("_n"))
        news = written(news, "set")
        self.stats["properties_set"] += news.count() * max(1, len(values))
        self._apply(b, news, values, whole)

    def _apply(self, b: NodeB | RelB, news: DataFrame, values: dict[str, Val], whole: bool) -> None:
        tables = self.graph.nodes if isinstance(b, NodeB) else self.graph.rels
        key = "_id" if isinstance(b, NodeB) else "_rid"
        fixed = {"_id", "_labels", "_rid", "_src", "_dst"}
        own_tables = self._own(b.tables) if isinstance(b, NodeB) else {i for i, r in enumerate(tables) if r.type in b.types}
        for i in sorted(own_tables):
            table = tables[i]
            own = table.props
            hit = F.col("_k").isNotNull()
            joined = (table.df if isinstance(b, NodeB) else self.graph.rel_frame(table)).join(news, F.col(key) == F.col("_k"), "left")
            columns = [F.col(x) for x in table.df.columns if x in fixed]
            for p in dict.fromkeys([*own, *values]):
                old = Val(c(p), own[p]) if p in own else v.null()
                if p in values:
                    n = list(values).index(p)
                    new = Val(F.col(f"_n{n}")["x"], STRING if values[p].type == NULL else values[p].type)
                    kind = v.merged(old.type, values[p].type)
                    if kind == NULL:
                        continue
                    new = v.null() if values[p].type == NULL else new
                    columns.append(F.when(hit, v.cast(new, kind)).otherwise(v.cast(old, kind)).alias(p))
                elif whole:
                    columns.append(F.when(hit, None).otherwise(old.col).alias(p))
                else:
                    columns.append(old.col.alias(p))
            if isinstance(b, NodeB):
                self._move(i, replace(table, df=joined.select(*columns)))
            else:
                tables[i] = replace(table, df=joined.select(*columns), carried=(), derived=False)

    def _change_labels(self, b: NodeB, labels: tuple, remove: bool) -> None:
        ids = written(self.frame.where(c(b.id).isNotNull()).select(c(b.id).alias("_k")).distinct(), "labels")
        self.stats["labels_removed" if remove else "labels_added"] += ids.count() * len(labels)
        change = F.array(*map(F.lit, labels))
        for i in sorted(self._own(b.tables)):
            n = self.graph.nodes[i]
            new = F.array_except("_labels", change) if remove else F.array_union("_labels", change)
            rows = n.df.join(ids, F.col("_id") == F.col("_k"), "left").withColumn("_labels", F.when(F.col("_k").isNotNull(), new).otherwise(F.col("_labels"))).drop("_k")
            self._move(i, NodeTable(rows, n.always - set(labels) if remove else n.always, n.maybe if remove else n.maybe | set(labels)))

    # --- DELETE ------------------------------------------------------------------------------

    def delete(self, k: t.Delete) -> None:
        nodes, rels = [], []
        own: set[int] | None = set()  # places of tables that may hold the nodes; None: any
        types: set[str] | None = set()
        for e in k.items:
            b = self.scope.get(e.name) if isinstance(e, t.Var) else None
            if isinstance(b, NodeB):
                own = own if own is None else own | self._own(b.tables)
                nodes.append(self.frame.select(c(b.id).alias("_k")))
            elif isinstance(b, RelB):
                types = types if types is None else types | set(b.types)
                rels.append(self.frame.select(c(b.key).alias("_k")))
            else:
                own = types = None
                self.prepare(e)
                x = self.ev(e)
                if v.is_path(x.type):
                    nodes.append(self.frame.select(F.explode(F.transform(x.col["_nodes"], lambda y: y["_id"])).alias("_k")))
                    rels.append(self.frame.select(F.explode(F.transform(x.col["_rels"], lambda y: y["_rid"])).alias("_k")))
                elif v.is_list(x.type) and (v.is_node(x.type.elementType) or v.is_rel(x.type.elementType)):
                    node = v.is_node(x.type.elementType)
                    (nodes if node else rels).append(self.frame.select(F.explode(F.transform(x.col, lambda y: y["_id" if node else "_rid"])).alias("_k")))
                elif v.is_node(x.type) or v.is_rel(x.type):
                    (nodes if v.is_node(x.type) else rels).append(self.frame.select(x.col["_id" if v.is_node(x.type) else "_rid"].alias("_k")))
                elif x.type != NULL:
                    raise CypherError("InvalidDelete")

        def gathered(frames: list[DataFrame]) -> DataFrame | None:
            if not frames:
                return None
            out = frames[0]
            for f in frames[1:]:
                out = out.union(f)
            return written(out.where("_k IS NOT NULL").distinct(), "deleted")

        gone_nodes, gone_rels = gathered(nodes), gathered(rels)
        if (most := self.options.get("max_deleted")) is not None and (targets := sum(x.count() for x in (gone_nodes, gone_rels) if x is not None)) > most:
            raise CypherError("DeleteLimit", f"{targets} targets", "execution")
        places = set(range(len(self.graph.nodes))) if own is None else own
        labels = {x for i in places for x in self.graph.nodes[i].maybe}
        for i, r in enumerate(self.graph.rels):
            gone = []
            if gone_rels is not None and (types is None or r.type in types):
                gone.append(r.df.select("_rid").join(gone_rels, F.col("_rid") == F.col("_k"), "left_semi"))
            if gone_nodes is not None and any(x is None or x & labels or not labels for x in (r.src, r.dst)):
                ends = r.df if not gone else r.df.join(gone_rels, F.col("_rid") == F.col("_k"), "left_anti")
                tied = written(ends.select("_rid", F.explode(F.array("_src", "_dst")).alias("_end")).join(gone_nodes, F.col("_end") == F.col("_k"), "left_semi").select("_rid"), "tied")
                if not k.detach and not tied.isEmpty():
                    raise CypherError("DeleteConnectedNode", "Cannot delete node with relationships without DETACH DELETE", "execution")
                gone.append(tied)
            if gone:
                rids = written((gone[0] if len(gone) == 1 else gone[0].union(gone[1])).distinct(), "deleted")
                if n := rids.count():
                    self.graph.rels[i] = replace(r, df=self.graph.rel_frame(r).join(rids, "_rid", "left_anti"), derived=False)
                    self.stats["relationships_deleted"] += n
        if gone_nodes is not None:
            for i in sorted(places):
                n = self.graph.nodes[i]
                self._move(i, replace(n, df=n.df.join(gone_nodes, F.col("_id") == F.col("_k"), "left_anti")))
            self.stats["nodes_deleted"] += gone_nodes.count()

    # --- FOREACH -----------------------------------------------------------------------------

    def foreach(self, k: t.Foreach) -> None:
        self.prepare(k.source)
        x = self.ev(k.source)
        if x.type == NULL:
            return
        if not v.is_list(x.type):
            raise CypherError("InvalidArgumentType", "FOREACH takes a list")
        if x.type.elementType == NULL:
            return
        self._settle()
        inner = Updater(self.graph, self.params, self.counter, self.options, self.moved)
        name = self.fresh()
        inner.frame, inner.unit = self.frame.withColumn(name, F.explode(x.col)), False
        inner.scope = dict(self.scope) | {k.var: ValB(name, x.type.elementType)}
        for q in k.body:
            inner.update(q)
        self._took(inner)
        self._rebind()


def _storable(key: str, x: Val) -> None:
    """Entities, and lists with entities or maps, aren't property values."""
    bad = lambda k: v.is_node(k) or v.is_rel(k) or v.is_path(k)
    if bad(x.type) or v.is_list(x.type) and (bad(x.type.elementType) or v.is_map(x.type.elementType) and not v.is_duration(x.type.elementType)):
        raise CypherError("InvalidPropertyType", key, "runtime")


def run_update(graph: PropertyGraph, text: str, params: dict, **options) -> tuple[PropertyGraph, DataFrame | None, dict]:
    query = parse(text)
    if len(query.parts) != 1:
        raise CypherError("InvalidClauseComposition", "UNION of updates")
    work = Updater(graph, params, options=options)
    work.run_clauses(query.parts[0])
    rows = work.result() if work.outputs is not None else None
    return work.graph, rows, work.stats

