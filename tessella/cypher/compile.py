"""Clauses to one lazy DataFrame.

Each variable is a group of flat, uniquely named columns, so that pruning and pushdown reach the
scans.  A node that a relationship leads to is only its id until a label, property or the whole node
is asked for; then its table is joined, and not before.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..functions import values as v
from ..functions.temporal import is_temporal
from ..functions.values import BOOL, LONG, NULL, STRING, Val
from ..sources.graph import NodeTable, PropertyGraph, RelTable
from ..sources.shared import written
from . import tree as t
from .errors import CypherError, ResourceLimitExceeded
from .parser import AGGREGATES, parse

_TEMPORAL = {"date", "time", "localtime", "datetime", "localdatetime", "duration"}
#: Hops of an unbounded pattern beyond which it is refused (option max_hops), and of a bounded one whose levels
#: aren't looked at between hops.
MOST_HOPS, UNROLLED = 64, 12


def c(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class NodeB:
    prefix: str
    tables: tuple  # of NodeTable: where it may be
    props: dict | None = None  # once loaded
    nullable: bool = False

    @property
    def id(self) -> str:
        return f"{self.prefix}__id"

    @property
    def columns(self) -> list[str]:
        return [self.id] + ([f"{self.prefix}__labels", *[f"{self.prefix}_p_{p}" for p in self.props]] if self.props is not None else [])

    @property
    def value(self) -> Val:
        kind = T.StructType().add("_id", LONG).add("_labels", T.ArrayType(STRING))
        for p, x in self.props.items():
            kind = kind.add(p, x)
        return Val(F.when(c(self.id).isNotNull(), F.struct(c(self.id).alias("_id"), c(f"{self.prefix}__labels").alias("_labels"), *[c(f"{self.prefix}_p_{p}").alias(p) for p in self.props])), kind)

    @property
    def key(self) -> str:
        return self.id


@dataclass(frozen=True)
class RelB:
    prefix: str
    types: tuple
    props: dict
    nullable: bool = False
    src: tuple = ()  # node tables
    dst: tuple = ()
    own: dict = field(default_factory=dict)  # near, far: properties of the node there, which the rows hold

    @property
    def key(self) -> str:
        return f"{self.prefix}__rid"

    @property
    def columns(self) -> list[str]:
        return [f"{self.prefix}__{x}" for x in ("rid", "type", "src", "dst")] + [f"{self.prefix}_p_{p}" for p in self.props]

    @property
    def value(self) -> Val:
        kind = T.StructType().add("_rid", LONG).add("_type", STRING).add("_src", LONG).add("_dst", LONG)
        for p, x in self.props.items():
            kind = kind.add(p, x)
        parts = [c(f"{self.prefix}__{x}").alias(f"_{x}") for x in ("rid", "type", "src", "dst")] + [c(f"{self.prefix}_p_{p}").alias(p) for p in self.props]
        return Val(F.when(c(self.key).isNotNull(), F.struct(*parts)), kind)


@dataclass(frozen=True)
class ValB:
    column: str
    type: T.DataType

    @property
    def columns(self) -> list[str]:
        return [self.column]

    @property
    def value(self) -> Val:
        return Val(c(self.column), self.type)


@dataclass(frozen=True)
class LamB:
    """A variable of a list expression."""

    value: Val
    columns: tuple = ()


def union_of(tables: list[NodeTable] | tuple, prefix: str, spark) -> tuple[DataFrame, dict]:
    """Node tables as one frame of a variable's columns; properties of one name get one type."""
    props: dict[str, T.DataType] = {}
    for n in tables:
        for p, x in n.props.items():
            props[p] = v.merged(props[p], x) if p in props else x
    frames = []
    for n in tables:
        own = n.props
        frames.append(n.df.select(F.col("_id").alias(f"{prefix}__id"), F.col("_labels").alias(f"{prefix}__labels"), *[(v.cast(Val(c(p), own[p]), x) if p in own else F.lit(None).cast(x)).alias(f"{prefix}_p_{p}") for p, x in props.items()]))
    if not frames:
        kind = T.StructType().add(f"{prefix}__id", LONG).add(f"{prefix}__labels", T.ArrayType(STRING))
        return spark.createDataFrame([], kind), {}
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out, props


def conjuncts(e: Any) -> list:
    if isinstance(e, t.Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [] if e is None else [e]


def names_in(e: Any) -> set[str]:
    """Names of variables that an expression or clause mentions."""
    out = set()
    for x in t.walk(e):
        if isinstance(x, t.Var):
            out.add(x.name)
        elif isinstance(x, (t.NodePattern, t.RelPattern)) and x.var:
            out.add(x.var)
        elif isinstance(x, t.SetItem):
            out.add(x.var)
    return out


def has_pattern(e: Any) -> bool:
    return any(isinstance(x, (t.PatternTest, t.Exists, t.PatternList)) for x in t.walk(e))


def is_aggregate(x: Any) -> bool:
    return isinstance(x, t.CountAll) or isinstance(x, t.Call) and x.name in AGGREGATES


def has_aggregate(e: Any) -> bool:
    """An aggregate of this level; those inside EXISTS belong to the subquery."""
    if is_aggregate(e):
        return True
    if isinstance(e, t.Exists):
        return False
    if isinstance(e, tuple):
        return any(map(has_aggregate, e))
    return hasattr(e, "__dataclass_fields__") and any(has_aggregate(getattr(e, f)) for f in e.__dataclass_fields__)


def _whole_uses(e: Any, out: set[str]) -> None:
    """Variables of which more than the id is needed."""
    if isinstance(e, t.Var):
        out.add(e.name)
    elif isinstance(e, t.NodePattern):
        if e.var and (e.labels or e.props):
            out.add(e.var)
        _whole_uses(e.props, out)
    elif isinstance(e, t.Call) and e.name in ("id", "count") and len(e.args) == 1 and isinstance(e.args[0], t.Var):
        pass
    elif isinstance(e, t.Binary) and e.op in ("=", "<>") and isinstance(e.left, t.Var) and isinstance(e.right, t.Var):
        pass
    elif isinstance(e, t.NullTest) and isinstance(e.of, t.Var):
        pass
    elif hasattr(e, "__dataclass_fields__"):
        for f in e.__dataclass_fields__:
            _whole_uses(getattr(e, f), out)
    elif isinstance(e, tuple):
        for x in e:
            _whole_uses(x, out)


class Compiler:
    def __init__(self, graph: PropertyGraph, params: dict, counter=None, options: dict | None = None):
        self.graph, self.spark, self.params = graph, graph.spark, params
        self.counter = counter or itertools.count()
        self.options = options or {}
        self.frame: DataFrame = self.spark.range(1).select(F.lit(True).alias("_unit"))
        self.unit = True  # one row, no variables
        self.scope: dict[str, Any] = {}
        self.imports: list[str] = []
        self.base: DataFrame | None = None
        self.used: list[tuple[str, str, set]] = []  # relationships of this MATCH: (one or many, column, types)
        self.outputs: list[str] | None = None

    def fresh(self) -> str:
        return f"v{next(self.counter)}"

    def child(self) -> Compiler:
        return Compiler(self.graph, self.params, self.counter, self.options)

    # --- scope -------------------------------------------------------------------------------

    def binding(self, name: str) -> Any:
        if name not in self.scope:
            raise CypherError("UndefinedVariable", name)
        return self.scope[name]

    def load(self, name: str) -> None:
        b = self.scope.get(name)
        if not isinstance(b, NodeB) or b.props is not None:
            return
        rows, props = union_of(b.tables, b.prefix, self.spark)
        key = f"{b.prefix}__key"
        rows = rows.withColumnRenamed(b.id, key)
        self.frame = self.frame.join(rows, c(b.id) == c(key), "left" if b.nullable else "inner").drop(key)
        self.scope[name] = replace(b, props=props)

    def prepare(self, *exprs: Any) -> None:
        need: set[str] = set()
        for e in exprs:
            _whole_uses(e, need)
        for n in sorted(need):
            self.load(n)

    # --- expressions -------------------------------------------------------------------------

    def ev(self, e: Any) -> Val:
        return getattr(self, f"_{type(e).__name__}")(e)

    def _Lit(self, e: t.Lit) -> Val:
        return v.lit(e.value)

    def _Param(self, e: t.Param) -> Val:
        return v.lit(self.params.get(e.name))

    def _Var(self, e: t.Var) -> Val:
        b = self.binding(e.name)
        if isinstance(b, NodeB) and b.props is None:
            return Val(F.when(c(b.id).isNotNull(), F.struct(c(b.id).alias("_id"), F.lit(None).cast("array<string>").alias("_labels"))), T.StructType().add("_id", LONG).add("_labels", T.ArrayType(STRING)))
        return b.value

    def _Prop(self, e: t.Prop) -> Val:
        if isinstance(e.of, t.Var):
            b = self.binding(e.of.name)
            if isinstance(b, (NodeB, RelB)):
                return Val(c(f"{b.prefix}_p_{e.key}"), b.props[e.key]) if e.key in (b.props or {}) else v.null()
        of = self.ev(e.of)
        if is_temporal(of.type) and not isinstance(e.of, (t.Var, t.Prop)):
            return v.let([of], lambda a: scalar.field(a[0], e.key))
        return scalar.field(of, e.key)

    def _Index(self, e: t.Index) -> Val:
        of, at = self.ev(e.of), self.ev(e.at)
        if v.is_list(of.type) and at.type not in (LONG, NULL):
            raise CypherError("InvalidArgumentType", "a list's index")
        return scalar.index(of, at)

    def _Slice(self, e: t.Slice) -> Val:
        return scalar.cut(self.ev(e.of), None if e.low is None else self.ev(e.low), None if e.high is None else self.ev(e.high))

    def _ListOf(self, e: t.ListOf) -> Val:
        return v.list_of([self.ev(x) for x in e.items])

    def _MapOf(self, e: t.MapOf) -> Val:
        return v.map_of({k: self.ev(x) for k, x in e.items})

    def _Unary(self, e: t.Unary) -> Val:
        x = self.ev(e.of)
        if e.op == "NOT":
            if x.type not in (BOOL, NULL):
                raise CypherError("InvalidArgumentType", "NOT takes a Boolean")
            return Val(~v.bool_of(x), BOOL)
        return v.negative(x)

    def _Binary(self, e: t.Binary) -> Val:
        a, b = self.ev(e.left), self.ev(e.right)
        if (is_temporal(a.type) or is_temporal(b.type)) and not all(isinstance(x, (t.Var, t.Prop, t.Lit)) for x in (e.left, e.right)):
            return v.let([a, b], lambda x: self._binary(e.op, *x))
        return self._binary(e.op, a, b)

    def _binary(self, op: str, a: Val, b: Val) -> Val:
        if op in ("AND", "OR", "XOR"):
            for x in (a, b):
                if isinstance(x.const, (int, float, str)) and not isinstance(x.const, bool) or v.is_list(x.type):
                    raise CypherError("InvalidArgumentType", f"{op} takes Booleans")
            p, q = v.bool_of(a), v.bool_of(b)
            return Val(p & q if op == "AND" else p | q if op == "OR" else p != q, BOOL)
        if op == "=":
            return v.equal(a, b)
        if op == "<>":
            return Val(~v.equal(a, b).col, BOOL)
        if op in ("<", "<=", ">", ">="):
            return v.compare(op, a, b)
        if op == "IN":
            return v.member(a, b)
        if op in ("STARTS WITH", "ENDS WITH", "CONTAINS"):
            if a.type != STRING or b.type != STRING:
                return v.null(BOOL)
            return Val({"STARTS WITH": F.startswith, "ENDS WITH": F.endswith, "CONTAINS": F.contains}[op](a.col, b.col), BOOL)
        if op == "+":
            return v.add(a, b)
        for x in (a, b):
            if isinstance(x.const, (str, bool)):
                raise CypherError("InvalidArgumentType", f"{op} takes numbers")
        return v.number(op, a, b)

    def _NullTest(self, e: t.NullTest) -> Val:
        x = self.ev(e.of).col
        if isinstance(e.of, t.Var) and isinstance(b := self.scope.get(e.of.name), (NodeB, RelB)):
            x = c(b.key)
        return Val(x.isNotNull() if e.negated else x.isNull(), BOOL)

    def _LabelTest(self, e: t.LabelTest) -> Val:
        x = self.ev(e.of)
        if v.is_rel(x.type):
            return Val(F.when(x.col.isNotNull(), x.col["_type"] == e.labels[0] if len(e.labels) == 1 else F.lit(False)), BOOL)
        if not v.is_node(x.type):
            if x.type == NULL:
                return v.null(BOOL)
            raise CypherError("InvalidArgumentType", "labels of something else than a node")
        out = F.lit(True)
        for label in e.labels:
            out = out & F.array_contains(x.col["_labels"], label)
        return Val(out, BOOL)

    def _Case(self, e: t.Case) -> Val:
        whens, default = [(self.ev(a), self.ev(b)) for a, b in e.whens], self.ev(e.default)
        kind = default.type
        for _, b in whens:
            kind = v.merged(kind, b.type)
        out = None
        for a, b in whens:
            out = F.when(v.bool_of(a), v.cast(b, kind)) if out is None else out.when(v.bool_of(a), v.cast(b, kind))
        return Val(out.otherwise(v.cast(default, kind)), kind)

    def _Call(self, e: t.Call) -> Val:
        if e.name in AGGREGATES:
            raise CypherError("InvalidAggregation", e.name)
        if e.distinct:
            raise CypherError("InvalidAggregation", "DISTINCT in a function")
        if e.name == "id" and len(e.args) == 1 and isinstance(e.args[0], t.Var) and isinstance(b := self.scope.get(e.args[0].name), (NodeB, RelB)):
            return Val(c(b.key), LONG)
        if e.name in ("startnode", "endnode"):
            return self._end_node(e)
        args = [self.ev(x) for x in e.args]
        if (e.name.split(".")[0] in _TEMPORAL or any(is_temporal(x.type) for x in args)) and not all(isinstance(x, (t.Var, t.Prop, t.Lit, t.Param)) for x in e.args):
            return v.let(args, lambda a: scalar.call(e.name, a))
        return scalar.call(e.name, args)

    def _end_node(self, e: t.Call) -> Val:
        b = self.scope.get(e.args[0].name) if e.args and isinstance(e.args[0], t.Var) else None
        if not isinstance(b, RelB):
            raise CypherError("InvalidArgumentType", f"{e.name} takes a relationship variable")
        prefix, end = self.fresh(), "src" if e.name == "startnode" else "dst"
        rows, props = union_of(b.src if end == "src" else b.dst, prefix, self.spark)
        self.frame = self.frame.join(rows, c(f"{b.prefix}__{end}") == c(f"{prefix}__id"), "left")
        return NodeB(prefix, (), props).value

    def _CountAll(self, e: t.CountAll) -> Val:
        raise CypherError("InvalidAggregation", "count(*)")

    def _with(self, **more: Any) -> Compiler:
        """This scope with list variables; frames stay shared."""
        out = self.child()
        out.frame, out.scope, out.unit = self.frame, self.scope | more, self.unit
        return out

    def _elements(self, e: Any) -> Val:
        x = self.ev(e)
        if x.type == NULL:
            return v.null(T.ArrayType(NULL))
        if not v.is_list(x.type):
            raise CypherError("InvalidArgumentType", "a list is needed", "runtime")
        return x

    def _Comprehension(self, e: t.Comprehension) -> Val:
        source = self._elements(e.source)
        item = lambda x: {e.var: LamB(Val(x, source.type.elementType))}
        out = source.col
        if e.where is not None:
            out = F.filter(out, lambda x: v.bool_of(self._with(**item(x)).ev(e.where)))
        if e.value is None:
            return Val(out, source.type)
        kinds: list[T.DataType] = []

        def value(x: Column) -> Column:
            r = self._with(**item(x)).ev(e.value)
            kinds.append(r.type)
            return r.col

        out = F.transform(out, value)
        return Val(out, T.ArrayType(kinds[0]))

    def _Quantifier(self, e: t.Quantifier) -> Val:
        source = self._elements(e.source)
        test = lambda x: v.bool_of(self._with(**{e.var: LamB(Val(x, source.type.elementType))}).ev(e.where))
        if e.kind == "any":
            return Val(F.exists(source.col, test), BOOL)
        if e.kind == "all":
            return Val(F.forall(source.col, test), BOOL)
        if e.kind == "none":
            return Val(~F.exists(source.col, test), BOOL)
        hits = F.size(F.filter(source.col, test))
        open_ = F.size(F.filter(source.col, lambda x: test(x).isNull()))
        return Val(F.when(source.col.isNull(), None).when(hits > 1, False).when(open_ > 0, None).otherwise(hits == 1), BOOL)

    def _Reduce(self, e: t.Reduce) -> Val:
        source, start = self._elements(e.source), self.ev(e.start)
        kind = start.type
        for _ in range(3):  # the accumulator's type is what the step makes of it
            found = []

            def step(a: Column, x: Column) -> Column:
                r = self._with(**{e.acc: LamB(Val(a, kind)), e.var: LamB(Val(x, source.type.elementType))}).ev(e.value)
                found.append(r.type)
                return v.cast(r, v.merged(kind, r.type))

            out = F.aggregate(source.col, v.cast(start, kind), step)
            wider = v.merged(kind, found[0])
            if wider == kind:
                break
            kind = wider
        return Val(out, kind)

    # --- patterns in expressions -------------------------------------------------------------

    def _outer_columns(self, names: set[str]) -> list[str]:
        return sorted({x for n in names if n in self.scope for x in self.scope[n].columns})

    def _sub(self, patterns: tuple, where: Any) -> tuple[Compiler, Column | None, set[str]]:
        """(compiled patterns on their own, what must hold between them and this frame, outer names that they mention)."""
        sub = self.child()
        shared = {}
        for p in patterns:
            for x in p.parts:
                if x.var and x.var in self.scope and x.var not in shared:
                    shared[x.var] = self.scope[x.var]
                    if isinstance(shared[x.var], NodeB):
                        sub.options = sub.options | {f"tables:{x.var}": shared[x.var].tables}
        sub.match_patterns(patterns, outer=self)
        on = None
        for name, b in shared.items():
            if not isinstance(b, (NodeB, RelB)) or name not in sub.scope:
                raise CypherError("VariableTypeConflict", name)
            same = c(b.key) == c(sub.scope[name].key)
            on = same if on is None else on & same
        mentioned = set(shared)
        for e in conjuncts(where):
            if not names_in(e) - sub.scope.keys() or not (names_in(e) & self.scope.keys()) - shared.keys() and not names_in(e) - sub.scope.keys():
                sub.filter(e)
            else:
                if has_pattern(e):
                    raise CypherError("NotSupported", "a pattern over variables of several levels", "execution")
                self.prepare(e)
                sub.prepare(e)
                both = self._with(**{n: b for n, b in sub.scope.items() if n not in self.scope})
                cond = v.bool_of(both.ev(e))
                on = cond if on is None else on & cond
                mentioned |= names_in(e) & self.scope.keys()
        for e in self._pattern_links(patterns, sub):
            on = e if on is None else on & e
        return sub, on, mentioned

    def _pattern_links(self, patterns: tuple, sub: Compiler) -> list[Column]:
        """Inline properties that mention outer variables."""
        out = []
        for target, props in sub.late:
            self.prepare(props)
            for key, e in props.items:
                sub_b = sub.scope[target] if target in sub.scope else None
                have = Val(c(f"{sub_b.prefix}_p_{key}"), sub_b.props[key]) if key in (sub_b.props or {}) else v.null()
                out.append(v.equal(have, self.ev(e)).col)
        return out

    late: list = []

    def _PatternTest(self, e: t.PatternTest) -> Val:
        return self._mark((e.pattern,), None)

    def _simple(self, q: t.Query) -> tuple[tuple, Any] | None:
        """The patterns and condition of a subquery that only matches."""
        if len(q.parts) != 1:
            return None
        patterns, where = (), None
        for k in q.parts[0]:
            if isinstance(k, t.Match) and not k.optional:
                patterns += k.patterns
                where = k.where if where is None else where if k.where is None else t.Binary("AND", where, k.where)
            elif not (isinstance(k, t.Project) and k.final and not any(has_aggregate(i.value) for i in k.items) and k.limit is None and k.skip is None):
                return None
        return (patterns, where) if patterns else None

    def _Exists(self, e: t.Exists) -> Val:
        if simple := self._simple(e.query):
            return self._mark(*simple)
        names = names_in(e.query) & self.scope.keys()
        self.prepare(*[t.Var(n) for n in names])
        return self._mark_rows(self.correlated(e.query, names), self._outer_columns(names))

    def _mark(self, patterns: tuple, where: Any) -> Val:
        sub, on, mentioned = self._sub(patterns, where)
        columns = self._outer_columns(mentioned)
        if not columns:
            hit = sub.frame.limit(1).select(F.lit(True).alias("_hit"))
            name = self.fresh()
            self.frame = self.frame.join(hit.withColumnRenamed("_hit", name), F.lit(True), "left")
            return Val(c(name).isNotNull(), BOOL)
        hits = self.frame.select(*map(c, columns)).distinct().join(sub.frame, on if on is not None else F.lit(True), "left_semi")
        return self._mark_rows(hits, columns)

    def _mark_rows(self, hits: DataFrame, columns: list[str]) -> Val:
        name = self.fresh()
        if not columns:
            self.frame = self.frame.join(hits.limit(1).select(F.lit(True).alias(name)), F.lit(True), "left")
        else:
            other = hits.select(*[c(x).alias(f"{name}_{k}") for k, x in enumerate(columns)]).distinct().withColumn(name, F.lit(True))
            on = F.lit(True)
            for k, x in enumerate(columns):
                on = on & c(x).eqNullSafe(c(f"{name}_{k}"))
            self.frame = self.frame.join(other, on, "left").drop(*[f"{name}_{k}" for k in range(len(columns))])
        return Val(c(name).isNotNull(), BOOL)

    def _PatternList(self, e: t.PatternList) -> Val:
        pattern = e.pattern
        sub, on, mentioned = self._sub((pattern,), e.where)
        outer_names = (names_in(e.value) & self.scope.keys()) - sub.scope.keys()
        self.prepare(e.value)
        sub.prepare(e.value)
        columns = self._outer_columns(mentioned | outer_names)
        base = self.frame.select(*map(c, columns)).distinct() if columns else self.spark.range(1).select(F.lit(True).alias("_one"))
        both = self._with(**{n: b for n, b in sub.scope.items() if n not in self.scope or n == pattern.var})
        r = both.ev(e.value)
        name = self.fresh()
        joined = base.join(sub.frame, on if on is not None else F.lit(True))
        lists = joined.select(*map(c, columns), F.struct(r.col.alias("x")).alias("_x")).groupBy(*map(c, columns)).agg(F.collect_list("_x").alias(name))
        lists = lists.select(*[c(x).alias(f"{name}_{k}") for k, x in enumerate(columns)], F.transform(c(name), lambda x: x["x"]).alias(name))
        cond = F.lit(True)
        for k, x in enumerate(columns):
            cond = cond & c(x).eqNullSafe(c(f"{name}_{k}"))
        self.frame = self.frame.join(lists, cond, "left").drop(*[f"{name}_{k}" for k in range(len(columns))])
        kind = T.ArrayType(r.type)
        empty = F.array().cast(kind) if r.type != NULL else F.array()
        return Val(F.coalesce(c(name), empty), kind)

    # --- filters -----------------------------------------------------------------------------

    def filter(self, where: Any) -> None:
        """Keeps rows where a condition is true; EXISTS and patterns that stand alone become semi and anti joins."""
        if where is None:
            return
        if has_aggregate(where):
            raise CypherError("InvalidAggregation", "WHERE")
        for e in conjuncts(where):
            inner, negated = e, False
            while isinstance(inner, t.Unary) and inner.op == "NOT":
                inner, negated = inner.of, not negated
            simple = ((inner.pattern,), None) if isinstance(inner, t.PatternTest) else self._simple(inner.query) if isinstance(inner, t.Exists) else None
            if simple:
                sub, on, mentioned = self._sub(*simple)
                if mentioned:
                    self.frame = self.frame.join(sub.frame, on if on is not None else F.lit(True), "left_anti" if negated else "left_semi")
                    continue
            self.prepare(e)
            self._check_names(e)
            cond = self.ev(e)
            if cond.type not in (BOOL, NULL):
                raise CypherError("InvalidArgumentType", "WHERE takes a Boolean")
            self.frame = self.frame.where(v.bool_of(cond))

    def _check_names(self, e: Any) -> None:
        for x in _free(e, set()):
            self.binding(x)

    # --- MATCH -------------------------------------------------------------------------------

    def match(self, k: t.Match) -> None:
        self._check_pattern_names(k.patterns)
        if not k.optional:
            self.used = []
            self.match_patterns(k.patterns)
            self.filter(k.where)
            return
        sub, on, mentioned = self._sub(k.patterns, k.where)
        before = set(self.scope)
        new = {n: b for n, b in sub.scope.items() if n not in before}
        keep = sorted({x for b in new.values() for x in b.columns})
        cols = sorted({x for n, b in sub.scope.items() if n in before for x in b.columns if x not in keep})
        self.frame = self.frame.join(sub.frame.select(*map(c, keep + cols + _extra(sub, keep + cols))), on if on is not None else F.lit(True), "left").drop(*cols)
        self.unit = False
        for n, b in new.items():
            self.scope[n] = replace(b, nullable=True) if isinstance(b, (NodeB, RelB)) else b

    def _check_pattern_names(self, patterns: tuple) -> None:
        seen_rels: set[str] = set()
        seen_nodes = {x.var for p in patterns for x in p.parts if isinstance(x, t.NodePattern)}
        for p in patterns:
            if p.var and p.var in self.scope:
                raise CypherError("VariableAlreadyBound", p.var)
            for x in p.parts:
                if isinstance(x, t.RelPattern) and x.var:
                    if x.var in seen_rels:
                        raise CypherError("RelationshipUniquenessViolation", x.var)
                    seen_rels.add(x.var)
                    if x.var in seen_nodes or isinstance(self.scope.get(x.var), NodeB):
                        raise CypherError("VariableTypeConflict", x.var)
                if isinstance(x, t.NodePattern) and x.var and (x.var in self.scope and not isinstance(self.scope[x.var], NodeB) or x.var in seen_rels):
                    raise CypherError("VariableTypeConflict", x.var)

    def match_patterns(self, patterns: tuple, outer: Compiler | None = None) -> None:
        self.late = []
        self.outer = outer
        for p in self._join_cycles(patterns) if self.unit and not self.scope else patterns:
            self._path(p)

    outer: Compiler | None = None

    def _join_cycles(self, patterns: tuple) -> list[t.PathPattern]:
        """Joins the patterns that close a cycle; the other paths, which are left to walk.

        Walked as written, a cycle multiplies rows until its last relationship finds both ends known.  So relationships of
        which a node has one at most, as LIVES_IN of a customer, are joined to one that reaches this node, which adds no
        rows, and the pieces that come of it are joined by all nodes that they share."""
        named = [replace(p, parts=tuple(replace(x, var=x.var or f" {self.fresh()}") for x in p.parts)) for p in patterns]
        groups: list[tuple[set, list]] = []  # connected nodes, places of their paths
        for i, p in enumerate(named):
            names, places = {x.var for x in p.parts[::2]}, [i]
            for g in [g for g in groups if g[0] & names]:
                groups.remove(g)
                names, places = names | g[0], g[1] + places
            groups.append((names, places))
        done = set()
        for names, places in groups:
            if pieces := self._pieces(names, [named[i] for i in places]):
                self._join_pieces(pieces)
                done |= {i for i in places if len(named[i].parts) > 1}
        return [p for i, p in enumerate(named) if i not in done]

    def _pieces(self, names: set[str], paths: list[t.PathPattern]) -> list[list[t.PathPattern]]:
        """Connected paths as groups of single relationships, none of which adds rows to the first of its group; empty where they are walked as written."""
        rels = [x for p in paths for x in p.parts[1::2]]
        if len(rels) < max(3, len(names)) or len({r.var for r in rels} - names) < len(rels):
            return []
        if any(p.var or p.shortest for p in paths) or any(r.hops is not None for r in rels) or any(names_in(x.props) for p in paths for x in p.parts):
            return []
        labels: dict[str, tuple] = {}
        for x in (x for p in paths for x in p.parts[::2]):
            labels[x.var] = tuple(dict.fromkeys((*labels.get(x.var, ()), *x.labels)))
        hops = [tuple(x if isinstance(x, t.RelPattern) else replace(x, labels=labels[x.var]) for x in p.parts[k : k + 3]) for p in paths for k in range(0, len(p.parts) - 1, 2)]
        single = {k: ends for k, hop in enumerate(hops) if (ends := self._single(*hop))}
        roots, pieces = [k for k in range(len(hops)) if k not in single] if single else [], []
        while roots or single:
            reached = {b for a, b in single.values() if a != b}
            root = roots.pop(0) if roots else next((k for k, (a, _) in single.items() if a not in reached), next(iter(single)))
            single.pop(root, None)
            piece, known = [hops[root]], {x.var for x in hops[root][::2]}
            while (k := next((k for k, (a, _) in single.items() if a in known), None)) is not None:
                known |= set(single.pop(k))
                piece.append(hops[k])
            pieces.append([t.PathPattern(None, None, hop) for hop in piece])
        return pieces

    def _single(self, x: t.NodePattern, r: t.RelPattern, y: t.NodePattern) -> tuple[str, str] | None:
        """(node that has one such relationship at most, the other end)."""
        found = self._candidates(r, self._tables(x), y)
        if len(found) != 1 or not found[0][0].carried:
            return None
        table, forward = found[0]
        return (x.var, y.var) if (table.carried[0][0] == "src") == forward else (y.var, x.var)

    def _join_pieces(self, pieces: list[list[t.PathPattern]]) -> None:
        made = []
        for piece in pieces:
            sub = self.child()
            for p in piece:
                sub._path(p)
            made.append(sub)
        whole = made.pop(0)
        while made:
            other = max(made, key=lambda x: len(x.scope.keys() & whole.scope.keys()))
            made.remove(other)
            whole._join(other)
        self._join(whole)

    def _join(self, other: Compiler) -> None:
        """The rows of both that agree in the nodes which both have, and whose relationships differ."""
        shared = sorted(self.scope.keys() & other.scope.keys())
        on = F.lit(True)
        for n in shared:
            on = on & (c(self.scope[n].id) == c(other.scope[n].id))
        self.frame = other.frame if self.unit else self.frame.join(other.frame, on) if shared else self.frame.crossJoin(other.frame)
        self.unit = False
        for _, column, types in self.used:
            for _, key, more in other.used:
                if types & more:
                    self.frame = self.frame.where(c(column) != c(key))
        self.used = self.used + other.used
        for n in shared:
            a, b = self.scope[n], other.scope[n]
            self.scope[n] = a if a.props is not None else b if b.props is not None else replace(a, tables=tuple(x for x in a.tables if x in b.tables))
        self.scope = other.scope | self.scope

    def _props(self, b: NodeB | RelB, name: str, props: Any) -> None:
        """Inline properties as equality filters; those over outer variables wait for the join."""
        if props is None:
            return
        if isinstance(props, t.Param):
            given = self.params.get(props.name)
            props = t.MapOf(tuple((k, t.Lit(x)) for k, x in (given or {}).items()))
        now, later = [], []
        for key, e in props.items:
            (later if self.outer is not None and names_in(e) - self.scope.keys() else now).append((key, e))
        if later:
            self.late.append((name, t.MapOf(tuple(later))))
        for key, e in now:
            have = Val(c(f"{b.prefix}_p_{key}"), b.props[key]) if key in b.props else v.null()
            self.frame = self.frame.where(v.equal(have, self.ev(e)).col)

    def _narrow(self, name: str, x: t.NodePattern) -> None:
        """Labels and properties of a pattern's node on a bound variable."""
        b = self.scope[name]
        if x.labels:
            fit = tuple(n for n in b.tables if set(x.labels) <= n.maybe)
            sure = len(fit) == len(b.tables) and all(set(x.labels) <= n.always for n in fit)
            if not sure:
                if b.props is None:
                    self.scope[name] = replace(b, tables=fit)
                self.load(name)
                if not all(set(x.labels) <= n.always for n in fit) or b.props is not None:
                    for label in x.labels:
                        self.frame = self.frame.where(F.array_contains(c(f"{b.prefix}__labels"), label))
        if x.props is not None:
            self.load(name)
            self._props(self.scope[name], name, x.props)

    def _tables(self, x: t.NodePattern) -> tuple:
        fit = self.graph.node_tables(x.labels)
        if x.var and (given := self.options.get(f"tables:{x.var}")) is not None:
            fit = [n for n in fit if n in given]
        return tuple(fit)

    def _start(self, name: str, x: t.NodePattern) -> None:
        prefix = self.fresh()
        fit = self._tables(x)
        rows, props = union_of(fit, prefix, self.spark)
        for label in x.labels:
            if not all(label in n.always for n in fit):
                rows = rows.where(F.array_contains(c(f"{prefix}__labels"), label))
        self.frame = rows if self.unit else self.frame.crossJoin(rows)
        self.unit = False
        self.scope[name] = NodeB(prefix, fit, props)
        self._props(self.scope[name], name, x.props)

    def _path(self, p: t.PathPattern) -> None:
        parts = [replace(x, var=x.var or f" {self.fresh()}") for x in p.parts]
        nodes, rels = parts[::2], parts[1::2]
        anchor = next((k for k, x in enumerate(nodes) if x.var in self.scope), None)
        bound_rel = next((k for k, x in enumerate(rels) if isinstance(self.scope.get(x.var), RelB)), None)
        if anchor is None and bound_rel is not None:
            anchor = bound_rel
            self._bind_end(nodes[anchor], rels[bound_rel])
        if anchor is None:
            # begin with the relationship alone where the first node asks for nothing that it doesn't tell
            first = nodes[0]
            if rels and rels[0].hops is None and first.props is None and self._begin_with_rel(first, rels[0], nodes[1]):
                self._build(p, nodes, rels, 0, done=1)
                return
            anchor = 0
            self._start(nodes[0].var, nodes[0])
        else:
            self._narrow(nodes[anchor].var, nodes[anchor])
        self._build(p, nodes, rels, anchor)

    def _build(self, p: t.PathPattern, nodes: list, rels: list, anchor: int, done: int = 0) -> None:
        pieces: dict[int, tuple] = {}
        if done:
            pieces[0] = ("one", rels[0].var)
        for k in range(anchor + done, len(rels)):
            pieces[k] = self._hop(nodes[k], rels[k], nodes[k + 1], p, False)
        for k in range(anchor - 1, -1, -1):
            pieces[k] = self._hop(nodes[k + 1], rels[k], nodes[k], p, True)
        if p.shortest:
            self._keep_shortest(p, nodes, pieces)
        if p.var:
            self._name_path(p.var, nodes, pieces)

    def _bind_end(self, x: t.NodePattern, r: t.RelPattern) -> None:
        """A node at a bound relationship, when neither of its ends is bound."""
        b = self.scope[r.var]
        prefix = self.fresh()
        if r.way == "both":
            ends = F.array_distinct(F.array(c(f"{b.prefix}__src"), c(f"{b.prefix}__dst")))
            self.frame = self.frame.withColumn(f"{prefix}__id", F.explode(ends))
            tables = tuple(dict.fromkeys((*b.src, *b.dst)))
        else:
            end = "src" if r.way == "out" else "dst"
            self.frame = self.frame.withColumn(f"{prefix}__id", c(f"{b.prefix}__{end}"))
            tables = b.src if end == "src" else b.dst
        self.scope[x.var] = NodeB(prefix, tuple(tables), nullable=b.nullable)

    def _candidates(self, r: t.RelPattern, near: tuple, far: t.NodePattern | None) -> list[tuple[RelTable, bool]]:
        """(table, whether it is walked from its source) that fit types, direction and labels."""
        out = []
        fits = lambda labels, tables: labels is None or any(labels & n.maybe for n in tables)
        far_tables = self._tables(far) if far is not None else tuple(self.graph.nodes)
        for table in self.graph.rels:
            if r.types and table.type not in r.types:
                continue
            for forward in (True, False):
                if forward and r.way == "in" or not forward and r.way == "out":
                    continue
                a, b = (table.src, table.dst) if forward else (table.dst, table.src)
                if fits(a, near) and fits(b, far_tables):
                    out.append((table, forward))
        return out

    def _ends(self, labels: frozenset | None) -> list[NodeTable]:
        return [n for n in self.graph.nodes if labels is None or labels & n.maybe]

    def _rel_rows(self, found: list, prefix: str, both: bool) -> tuple[DataFrame, RelB, tuple, tuple]:
        """(rows with near and far, binding, tables of the far ends, of the near ends)."""
        props: dict[str, T.DataType] = {}
        for table, _ in found:
            for p, x in table.props.items():
                props[p] = v.merged(props[p], x) if p in props else x
        frames, far, near, src, dst = [], {}, {}, {}, {}
        carried: dict[str, tuple] = {}  # ends whose nodes the relationship's own rows tell
        if len(found) == 1:
            table, forward = found[0]
            for end, node, labels in table.carried:
                if self._ends(table.src if end == "src" else table.dst) == [node]:
                    carried["far" if (end == "dst") == forward else "near"] = (end, node, labels)
        for table, forward in found:
            own = table.props
            a, b = ("_src", "_dst") if forward else ("_dst", "_src")
            rows = self.graph.rel_frame(table)
            if both and not forward and any(x is table and f for x, f in found):
                rows = rows.where("_src <> _dst")  # a loop is walked once
            frames.append(rows.select(
                F.col("_rid").alias(f"{prefix}__rid"), F.lit(table.type).alias(f"{prefix}__type"), F.col("_src").alias(f"{prefix}__src"), F.col("_dst").alias(f"{prefix}__dst"), F.col(a).alias(f"{prefix}__near"), F.col(b).alias(f"{prefix}__far"),
                *[(v.cast(Val(c(p), own[p]), x) if p in own else F.lit(None).cast(x)).alias(f"{prefix}_p_{p}") for p, x in props.items()],
                *[x for side, (end, node, labels) in carried.items() for x in [F.array(*map(F.lit, labels)).alias(f"{prefix}__{side}__labels"), *[c(f"_at_{end}_{p}").alias(f"{prefix}__{side}_p_{p}") for p in node.props]]],
            ))
            for into, labels in ((far, table.dst if forward else table.src), (near, table.src if forward else table.dst), (src, table.src), (dst, table.dst)):
                into |= {id(n): n for n in self._ends(labels)}
        binding = RelB(prefix, tuple(sorted({x.type for x, _ in found})), props, src=tuple(src.values()), dst=tuple(dst.values()), own={side: node.props for side, (_, node, _) in carried.items()})
        if not frames:
            kind = T.StructType().add(f"{prefix}__rid", LONG).add(f"{prefix}__type", STRING)
            for x in ("src", "dst", "near", "far"):
                kind = kind.add(f"{prefix}__{x}", LONG)
            return self.spark.createDataFrame([], kind), binding, (), ()
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        return out, binding, tuple(far.values()), tuple(near.values())

    def _begin_with_rel(self, x: t.NodePattern, r: t.RelPattern, y: t.NodePattern) -> bool:
        if y.var in self.scope or x.var == y.var or r.var in self.scope:
            return False
        tables = self._tables(x)
        found = self._candidates(r, tables, y)
        prefix, start = self.fresh(), self.fresh()
        rows, b, far, near = self._rel_rows(found, prefix, r.way == "both")
        if x.labels and not (all(set(x.labels) <= n.always for n in near)):
            return False
        rows = rows.withColumn(f"{start}__id", c(f"{prefix}__near"))
        self.frame = rows if self.unit else self.frame.crossJoin(rows)
        self.unit = False
        self.scope[x.var] = self._at_end(b, "near", start, near)
        self._arrive(b, r, y, far)
        return True

    def _at_end(self, b: RelB, side: str, prefix: str, tables: tuple) -> NodeB:
        """The node at an end of a relationship, with its properties where they are at hand."""
        props = b.own.get(side)
        if props is not None:
            self.frame = self.frame.withColumns({f"{prefix}__labels": c(f"{b.prefix}__{side}__labels")} | {f"{prefix}_p_{p}": c(f"{b.prefix}__{side}_p_{p}") for p in props})
        return NodeB(prefix, tables, props)

    def _arrive(self, b: RelB, r: t.RelPattern, y: t.NodePattern, far: tuple) -> None:
        """After the join with a relationship: its variable, the node it leads to, and their conditions."""
        for kind, column, types in self.used:
            if types & set(b.types):
                self.frame = self.frame.where(c(b.key) != c(column) if kind == "one" else ~F.array_contains(c(column), c(b.key)))
        self.used.append(("one", b.key, set(b.types)))
        self.scope[r.var] = b
        self._props(b, r.var, r.props)
        if y.var in self.scope:
            self._narrow(y.var, y)
            return
        prefix = self.fresh()
        self.frame = self.frame.withColumn(f"{prefix}__id", c(f"{b.prefix}__far"))
        self.scope[y.var] = self._at_end(b, "far", prefix, far)
        self._narrow(y.var, y)

    def _hop(self, x: t.NodePattern, r: t.RelPattern, y: t.NodePattern, p: t.PathPattern, backwards: bool) -> tuple:
        """From the bound node x to y; backwards: the pattern has y first."""
        if backwards and r.way != "both":
            r = replace(r, way="in" if r.way == "out" else "out")
        near = self.scope[x.var]
        if r.hops is not None:
            return self._hops(near, r, y, p, backwards)
        old = self.scope.get(r.var)
        if isinstance(old, RelB):  # the relationship is known: only its ends are checked and bound
            a, b = c(f"{old.prefix}__src"), c(f"{old.prefix}__dst")
            if r.way == "in":
                a, b = b, a
            here = c(near.id)
            far = F.when(here == a, b).when(here == b, a) if r.way == "both" else F.when(here == a, b)
            self.frame = self.frame.where(far.isNotNull())
            if y.var in self.scope:
                self.frame = self.frame.where(far == c(self.scope[y.var].id))
            else:
                prefix = self.fresh()
                self.frame = self.frame.withColumn(f"{prefix}__id", far)
                self.scope[y.var] = NodeB(prefix, tuple(dict.fromkeys((*old.src, *old.dst))) if r.way == "both" else old.dst if r.way == "out" else old.src)
            if r.types:
                self.frame = self.frame.where(c(f"{old.prefix}__type").isin(*r.types))
            self._narrow(y.var, y)
            return ("one", r.var)
        prefix = self.fresh()
        rows, b, far, _ = self._rel_rows(self._candidates(r, near.tables, y if y.var not in self.scope else None), prefix, r.way == "both")
        on = c(near.id) == c(f"{prefix}__near")
        if y.var in self.scope:
            on = on & (c(f"{prefix}__far") == c(self.scope[y.var].id))
        self.frame = self.frame.join(rows, on)
        self._arrive(b, r, y, far)
        return ("one", r.var)

    def _hops(self, near: NodeB, r: t.RelPattern, y: t.NodePattern, p: t.PathPattern, backwards: bool) -> tuple:
        low, high = r.hops
        if high is not None and high < low:
            high = -1
        whole = p.var is not None or r.var and not r.var.startswith(" ")
        prefix, out = self.fresh(), self.fresh()
        # nodes on the way may be anything that the types allow
        found = self._walkable(r, near.tables)
        rows, b, far, _ = self._rel_rows(found, prefix, r.way == "both")
        if r.props is not None:
            sub = self.child()
            sub.frame, sub.scope, sub.unit = rows, {"r": b}, False
            if names_in(r.props):
                raise CypherError("NotSupported", "properties over other variables on a path of several relationships", "execution")
            sub._props(b, "r", r.props)
            rows = sub.frame
        node_kind = None
        if whole:
            node = self.fresh()
            nodes, props = union_of(far, node, self.spark)
            node_value = NodeB(node, (), props).value
            node_kind = node_value.type
            rows = rows.join(nodes, c(f"{prefix}__far") == c(f"{node}__id"), "left").select(*map(c, b.columns), c(f"{prefix}__near"), c(f"{prefix}__far"), node_value.col.alias(f"{prefix}__node"))
        keep = self.frame.columns
        rids, rels, seen, end = f"{out}__rids", f"{out}__rels", f"{out}__nodes", f"{out}__id"
        short = self._breadth_first(p, r, low)
        base = self.frame
        if short:  # from each start once, whatever else its rows hold
            start = f"{out}__start"
            base, keep = base.select(c(near.id).alias(start)).where(c(start).isNotNull()).distinct(), [start]
        level = base.withColumns({end: c(start if short else near.id), rids: F.array().cast("array<bigint>")} | ({rels: F.array().cast(T.ArrayType(b.value.type)), seen: F.array().cast(T.ArrayType(node_kind))} if whole else {}))
        levels = [level] if low == 0 else []
        most_hops = self.options.get("max_hops", MOST_HOPS)
        hop = 0
        while high is None or hop < high:
            hop += 1
            step = level.join(rows, (c(end) == c(f"{prefix}__near")) & ~F.array_contains(c(rids), c(b.key)))
            grown = [*map(c, keep), c(f"{prefix}__far").alias(end), F.concat(c(rids), F.array(c(b.key))).alias(rids)]
            if whole:
                grown += [F.concat(c(rels), F.array(b.value.col)).alias(rels), F.concat(c(seen), F.array(c(f"{prefix}__node"))).alias(seen)]
            level = step.select(*grown)
            if short:
                level = self._newly_reached(level, levels, start, end, rids, p.shortest)
            # a level is read by its union and by the next hop, so it is made once; the first two are as cheap made again
            if short or high is None or high > UNROLLED or 2 <= hop < high:
                level = written(level, "hops")
                if (short or high is None or high > UNROLLED) and level.isEmpty():
                    break
                if high is None and hop > most_hops:
                    raise ResourceLimitExceeded("Hops", most_hops, hop, "an unbounded pattern; max_hops lifts this")
                most = self.options.get("max_intermediate_rows")
                if most and (n := level.count()) > most:
                    raise ResourceLimitExceeded("IntermediateRows", most, n, f"hop {hop}")
            if hop >= low:
                levels.append(level)
        if not levels:
            levels = [level.where(F.lit(False))]
        found = levels[0]
        for x in levels[1:]:
            found = found.union(x)
        self.frame = self.frame.join(found, c(near.id) == c(start)).drop(start) if short else found
        for kind, column, types in self.used:
            if types & set(b.types):
                self.frame = self.frame.where(~F.array_contains(c(rids), c(column)) if kind == "one" else ~F.arrays_overlap(c(rids), c(column)))
        self.used.append(("many", rids, set(b.types)))
        if whole and backwards:
            self.frame = self.frame.withColumn(rels, F.reverse(c(rels)))
        if isinstance(old := self.scope.get(r.var), ValB):
            self.frame = self.frame.where(F.transform(c(old.column), lambda x: x["_rid"]) == F.transform(c(rels), lambda x: x["_rid"]))
        elif whole:
            self.scope[r.var] = ValB(rels, T.ArrayType(b.value.type))
        if y.var in self.scope:
            self.frame = self.frame.where(c(end) == c(self.scope[y.var].id))
        else:
            tables = tuple(dict.fromkeys((*far, *(near.tables if low == 0 else ()))))
            self.scope[y.var] = NodeB(out, tables)
        self._narrow(y.var, y)
        return ("many", rids, rels, seen, b, node_kind, backwards, short)

    def _breadth_first(self, p: t.PathPattern, r: t.RelPattern, low: int) -> bool:
        """Whether a pattern's shortest paths are those of a search that visits each node once for each start.

        Along undirected relationships such a search finds no way back to its start, which shortestPath
        takes as no path."""
        return p.shortest is not None and len(p.parts) == 3 and low <= 1 and not self.options.get("parity")

    def _newly_reached(self, level: DataFrame, levels: list[DataFrame], start: str, end: str, rids: str, kind: str) -> DataFrame:
        """Of paths one hop longer, those to nodes that no shorter one reaches; one for each node, or all of them."""
        if levels:
            past = levels[0].select(c(start).alias("_past_start"), c(end).alias("_past_end"))
            for x in levels[1:]:
                past = past.union(x.select(c(start), c(end)))
            level = level.join(past, (c(start) == F.col("_past_start")) & (c(end) == F.col("_past_end")), "left_anti")
        if kind == "all":
            return level
        others = [x for x in level.columns if x not in (start, end)]
        best = level.groupBy(c(start), c(end)).agg(F.min_by(F.struct(*map(c, others)), c(rids)).alias("_best"))
        return best.select(c(start), c(end), *[F.col("_best")[x].alias(x) for x in others]).select(*map(c, level.columns))

    def _walkable(self, r: t.RelPattern, near: tuple) -> list:
        """Relationship tables that any number of hops may reach."""
        found: list = []
        tables, before = set(near), -1
        while len(found) != before:
            before = len(found)
            found = self._candidates(r, tuple(tables), None)
            for table, forward in found:
                tables |= set(self._ends(table.dst if forward else table.src))
        return found

    def _keep_shortest(self, p: t.PathPattern, nodes: list, pieces: dict) -> None:
        if pieces[0][0] != "many" or pieces[0][7] or self.options.get("parity"):
            return
        rids = pieces[0][1]
        ends = [c(self.scope[nodes[0].var].id), c(self.scope[nodes[-1].var].id)]
        best = self.fresh()
        w = W.partitionBy(*ends)
        if p.shortest == "all":
            self.frame = self.frame.withColumn(best, F.min(F.size(c(rids))).over(w)).where(F.size(c(rids)) == c(best)).drop(best)
        else:
            self.frame = self.frame.withColumn(best, F.row_number().over(w.orderBy(F.size(c(rids)), c(rids)))).where(c(best) == 1).drop(best)

    def _name_path(self, name: str, nodes: list, pieces: dict) -> None:
        for x in nodes:
            self.load(x.var)
        node_kind: T.DataType = NULL
        rel_kind: T.DataType = NULL
        for x in nodes:
            node_kind = v.merged(node_kind, self.scope[x.var].value.type)
        for q in pieces.values():
            if q[0] == "one":
                rel_kind = v.merged(rel_kind, self.scope[q[1]].value.type)
            else:
                rel_kind, node_kind = v.merged(rel_kind, q[4].value.type), v.merged(node_kind, q[5])
        at = [F.array(v.cast(self.scope[nodes[0].var].value, node_kind))]
        along = []
        for k in range(len(pieces)):
            q, after = pieces[k], self.scope[nodes[k + 1].var].value
            if q[0] == "one":
                along.append(F.array(v.cast(self.scope[q[1]].value, rel_kind)))
                at.append(F.array(v.cast(after, node_kind)))
            else:
                along.append(v.cast(Val(c(q[2]), T.ArrayType(q[4].value.type)), T.ArrayType(rel_kind)))
                seen = v.cast(Val(c(q[3]), T.ArrayType(q[5])), T.ArrayType(node_kind))
                if q[6]:
                    # walked from the other end: what was seen, turned round, without the start, then the end walked from
                    n = F.size(seen)
                    turned = F.when(n == 0, seen).otherwise(F.concat(F.slice(F.reverse(seen), F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(v.cast(after, node_kind))))
                    at.append(turned)
                else:
                    at.append(seen)
        if rel_kind == NULL:
            rel_kind = T.StructType().add("_rid", LONG).add("_type", STRING).add("_src", LONG).add("_dst", LONG)
            along = [F.array().cast(T.ArrayType(rel_kind))]
        column = self.fresh()
        value = F.struct(F.concat(*at).alias("_nodes"), F.concat(*along).alias("_rels"))
        self.frame = self.frame.withColumn(column, value)
        self.scope[name] = ValB(column, T.StructType().add("_nodes", T.ArrayType(node_kind)).add("_rels", T.ArrayType(rel_kind)))

    # --- other reading clauses ---------------------------------------------------------------

    def unwind(self, k: t.Unwind) -> None:
        if k.var in self.scope:
            raise CypherError("VariableAlreadyBound", k.var)
        self._check_names(k.value)
        self.prepare(k.value)
        x = self.ev(k.value)
        name = self.fresh()
        if x.type == NULL:
            self.frame = self.frame.where(F.lit(False)).withColumn(name, F.lit(None).cast("string"))
            self.scope[k.var] = ValB(name, STRING)
        elif v.is_list(x.type):
            source = x.col
            if x.type.elementType == NULL:
                self.frame, kind = self.frame.withColumn(name, F.explode(F.transform(source, lambda y: y.cast("string")))), STRING
            else:
                self.frame, kind = self.frame.withColumn(name, F.explode(source)), x.type.elementType
            self.scope[k.var] = ValB(name, kind)
        else:
            self.frame = self.frame.withColumn(name, x.col).where(c(name).isNotNull())
            self.scope[k.var] = ValB(name, x.type)
        self.unit = False

    def call_query(self, k: t.CallQuery) -> None:
        first = k.query.parts[0][0]
        names: set[str] = set()
        query = k.query
        if isinstance(first, t.Project) and not first.final and all(isinstance(i.value, t.Var) and i.value.name in self.scope for i in first.items) and (first.items or first.star):
            names = set(self.scope) if first.star else {i.value.name for i in first.items}
        if names:
            for n in names:
                self.load(n)
            rows, made = self._correlated_rows(query, names)
            self._attach(rows, made, self._outer_columns(names))
        else:
            sub = self.child()
            sub.run(query)
            self._new_names(sub.scope)
            self.frame = sub.frame if self.unit else self.frame.crossJoin(sub.frame)
        self.unit = False

    def _new_names(self, made: dict) -> None:
        for n, b in made.items():
            if n in self.scope:
                raise CypherError("VariableAlreadyBound", n)
            self.scope[n] = b

    def correlated(self, query: t.Query, names: set[str]) -> DataFrame:
        return self._correlated_rows(query, names)[0]

    def _correlated_rows(self, query: t.Query, names: set[str]) -> tuple[DataFrame, dict]:
        """Rows of a subquery for each distinct value of the imported variables, whose columns they keep."""
        columns = self._outer_columns(names)
        base = self.frame.select(*map(c, columns)).distinct()
        sub = self.child()
        sub.frame, sub.base, sub.imports, sub.unit = base, base, columns, False
        sub.scope = {n: self.scope[n] for n in names}
        sub.run(query)
        return sub.frame, {n: b for n, b in sub.scope.items()}

    def _attach(self, rows: DataFrame, made: dict, columns: list[str]) -> None:
        name = self.fresh()
        rows = rows.withColumnsRenamed({x: f"{name}_{k}" for k, x in enumerate(columns)})
        on = F.lit(True)
        for k, x in enumerate(columns):
            on = on & c(x).eqNullSafe(c(f"{name}_{k}"))
        self._new_names({n: b for n, b in made.items() if not set(b.columns) & set(columns)})
        self.frame = self.frame.join(rows, on).drop(*[f"{name}_{k}" for k in range(len(columns))])

    def call_procedure(self, k: t.CallProcedure, alone: bool) -> None:
        from ..operators.procedures import BUILT_IN

        known = BUILT_IN | self.graph.procedures
        if k.name.lower() not in known:
            raise CypherError("ProcedureNotFound", k.name)
        inputs, outputs, run = known[k.name.lower()]
        if k.args is None:
            if missing := [x for x in inputs if x not in self.params]:
                raise CypherError("MissingParameter", missing[0])
            args = [v.lit(self.params[x]) for x in inputs]
        else:
            if len(k.args) != len(inputs):
                raise CypherError("InvalidNumberOfArguments", k.name)
            self.prepare(*k.args)
            args = [self.ev(x) for x in k.args]
        if k.yields == () and not alone:
            raise CypherError("UnexpectedSyntax", "YIELD * stands alone only")
        yields = k.yields or (tuple((f, f) for f in outputs) if alone else ())
        name = self.fresh()
        self.frame = self.frame.withColumn(name, F.explode(run(*[x.col for x in args])))
        self.unit = False
        for f, alias in yields:
            if f not in outputs:
                raise CypherError("ProcedureNotFound", f"{k.name} yields no {f}")
            if alias in self.scope:
                raise CypherError("VariableAlreadyBound", alias)
            column = self.fresh()
            self.frame = self.frame.withColumn(column, c(name)[f])
            self.scope[alias] = ValB(column, outputs[f])
        self.frame = self.frame.drop(name)
        if alone:
            self.outputs = [a for _, a in yields]

    # --- projection --------------------------------------------------------------------------

    def project(self, k: t.Project) -> None:
        items = list(k.items)
        if k.star:
            visible = sorted(n for n in self.scope if not n.startswith(" "))
            if not visible and k.final:
                raise CypherError("NoVariablesInScope")
            items = [t.Item(t.Var(n), n, True) for n in visible] + items
        names = [i.name for i in items]
        if len(set(names)) != len(names):
            raise CypherError("ColumnNameConflict", next(n for n in names if names.count(n) > 1))
        if not k.final:
            for i in items:
                if not i.aliased:
                    raise CypherError("NoExpressionAlias", i.name)
        for i in items:
            if any(isinstance(x, t.PatternTest) for x in t.walk(i.value)) and not any(isinstance(x, (t.Exists, t.PatternList)) for x in t.walk(i.value)):
                raise CypherError("UnexpectedSyntax", "a pattern in a projection")
            for x in t.walk(i.value):
                if is_aggregate(x) and any(has_aggregate(y) for y in getattr(x, "args", ())):
                    raise CypherError("NestedAggregation")
        aggregated = any(has_aggregate(i.value) for i in items)
        for i in items:
            self._check_names(i.value)
        aliases = {i.name: i.value for i in items}
        orders = []
        for o in k.order:
            e = o.value
            if has_aggregate(e) and not aggregated:
                raise CypherError("InvalidAggregation", "ORDER BY")
            orders.append((e, o.down))
        if aggregated:
            self._aggregate(items, aliases, orders, k)
        else:
            self._select(items, aliases, orders, k)
        self.used = []
        if k.final:
            self.outputs = names

    def _bind(self, e: Any) -> tuple[Any, dict[str, Column]]:
        """(binding, columns to make) of an item's value."""
        if isinstance(e, t.Var):
            b = self.binding(e.name)
            if not isinstance(b, LamB):
                return b, {}
        x = self.ev(e)
        name = self.fresh()
        if x.type == NULL:
            return ValB(name, STRING), {name: F.lit(None).cast("string")}
        kind = _settled(x.type)
        return ValB(name, kind), {name: v.cast(x, kind) if kind != x.type else x.col}

    def _select(self, items: list, aliases: dict, orders: list, k: t.Project) -> None:
        whole = [i.value for i in items] if k.final else [i.value for i in items if not isinstance(i.value, t.Var)]
        self.prepare(*whole, *[e for e, _ in orders])
        made: dict[str, Any] = {}
        for i in items:
            made[i.name], new = self._bind(i.value)
            if new:
                self.frame = self.frame.withColumns(new)
        old = self.scope
        self.scope = old | made
        if k.where is not None:
            self.filter(k.where)
            made = {n: self.scope[n] for n in made}
        keys: list[Column] = []
        if k.distinct:
            self._distinct(made)
            self.scope = dict(made)
        for e, down in orders:
            e = next((t.Var(n) for n, x in aliases.items() if x == e), e)
            self._check_names(e)
            self.prepare(e)
            keys += v.order(self.ev(e), down)
        made = {n: self.scope[n] for n in made}
        self._cut(k, keys, made)

    def _distinct(self, made: dict) -> None:
        keys = list(dict.fromkeys(self.imports + [b.key if isinstance(b, (NodeB, RelB)) else b.column for b in made.values()]))
        columns = list(dict.fromkeys([x for b in made.values() for x in b.columns] + self.imports))
        rows = self.frame.select(*map(c, columns))
        if set(keys) == set(columns):
            self.frame = rows.distinct()
        else:
            self.frame = rows.groupBy(*map(c, keys)).agg(*[F.first(c(x)).alias(x) for x in columns if x not in keys])

    def _constant(self, e: Any, what: str) -> int:
        if names_in(e) or has_aggregate(e):
            raise CypherError("NonConstantExpression", what)
        if isinstance(e, t.Lit):
            n = e.value
        elif isinstance(e, t.Param):
            n = self.params.get(e.name)
        else:
            x = self.child().ev(e)
            n = self.spark.range(1).select(x.col.alias("n")).first()[0]
        if isinstance(n, bool) or not isinstance(n, int):
            raise CypherError("InvalidArgumentType", what)
        if n < 0:
            raise CypherError("NegativeIntegerArgument", what)
        return n

    def _cut(self, k: t.Project, keys: list[Column], made: dict) -> None:
        skip = self._constant(k.skip, "SKIP") if k.skip is not None else None
        limit = self._constant(k.limit, "LIMIT") if k.limit is not None else None
        if self.imports and (skip is not None or limit is not None):
            n = self.fresh()
            rows = self.frame.withColumn(n, F.row_number().over(W.partitionBy(*map(c, self.imports)).orderBy(*keys or [F.lit(1)])))
            low = skip or 0
            rows = rows.where(c(n) > low)
            self.frame = (rows.where(c(n) <= low + limit) if limit is not None else rows).drop(n)
        else:
            if keys:
                self.frame = self.frame.orderBy(*keys)
            if skip:
                self.frame = self.frame.offset(skip)
            if limit is not None:
                self.frame = self.frame.limit(limit)
        self.scope = dict(made)
        columns = list(dict.fromkeys([x for b in made.values() for x in b.columns] + self.imports))
        self.frame = self.frame.select(*map(c, columns)) if columns else self.frame
        self.unit = False

    # --- aggregation -------------------------------------------------------------------------

    def _aggregate(self, items: list, aliases: dict, orders: list, k: t.Project) -> None:
        order_exprs = []
        for e, down in orders:
            if isinstance(e, t.Var) and e.name in aliases:
                e = aliases[e.name]
            order_exprs.append((e, down))
        self.prepare(*[i.value for i in items if not isinstance(i.value, t.Var)], *[x for i in items for x in t.walk(i.value) if is_aggregate(x)], *[e for e, _ in order_exprs])
        if k.final:
            self.prepare(*[i.value for i in items])
        plain = [i for i in items if not has_aggregate(i.value)]
        groups: dict[Any, Any] = {}  # expression: binding
        for i in plain:
            groups[i.value], new = self._bind(i.value)
            if new:
                self.frame = self.frame.withColumns(new)
        found = list(dict.fromkeys(x for e in [*[i.value for i in items], *[e for e, _ in order_exprs]] for x in t.walk(e) if is_aggregate(x)))
        aggs, swap, fill = [], {}, {}
        for x in found:
            name = self.fresh()
            col, kind, empty = self._one_aggregate(x)
            aggs.append(col.alias(name))
            swap[x] = (name, kind)
            if empty is not None:
                fill[name] = empty
        keys = list(dict.fromkeys(self.imports + [b.key if isinstance(b, (NodeB, RelB)) else b.column for b in groups.values()]))
        extra = [x for x in dict.fromkeys(x for b in groups.values() for x in b.columns) if x not in keys]
        aggs += [F.first(c(x)).alias(x) for x in extra]
        if keys:
            rows = self.frame.groupBy(*map(c, keys)).agg(*aggs)
            if self.base is not None and not groups:
                # every outer row has a result, also of no rows
                n = self.fresh()
                rows = rows.withColumnsRenamed({x: f"{n}_{j}" for j, x in enumerate(self.imports)})
                on = F.lit(True)
                for j, x in enumerate(self.imports):
                    on = on & c(x).eqNullSafe(c(f"{n}_{j}"))
                rows = self.base.join(rows, on, "left").drop(*[f"{n}_{j}" for j in range(len(self.imports))])
                rows = rows.withColumns({x: F.coalesce(c(x), e) for x, e in fill.items()})
        else:
            rows = self.frame.agg(*aggs)
        self.frame, self.unit = rows, False
        self.scope = {i.value.name: groups[i.value] for i in plain if isinstance(i.value, t.Var)}
        hidden: dict[Any, t.Var] = {}
        for x, (name, kind) in swap.items():
            hidden[x] = t.Var(f" {name}")
            self.scope[f" {name}"] = ValB(name, kind)
        for e, b in groups.items():
            if not isinstance(e, t.Var):
                hidden[e] = t.Var(f" {b.columns[0]}")
                self.scope[f" {b.columns[0]}"] = b
        made: dict[str, Any] = {}
        keyed = dict(self.scope)
        for i in items:
            e = _swapped(i.value, hidden)
            if has_aggregate(i.value):
                for n in _free(e, set()):
                    if n not in keyed:
                        raise CypherError("AmbiguousAggregationExpression", i.name)
            made[i.name], new = self._bind(e)
            if new:
                self.frame = self.frame.withColumns(new)
        scope = self.scope | made
        self.scope = scope
        if k.where is not None:
            self.scope = dict(made)
            self.filter(k.where)
            made = {n: self.scope[n] for n in made}
            self.scope = scope | made
        if k.distinct:
            self._distinct(made)
            self.scope = dict(made)
        sort_keys: list[Column] = []
        for (e, down), (was, _) in zip(order_exprs, orders):
            name = next((n for n, x in aliases.items() if x == e), None)
            e = t.Var(name) if name else _swapped(e, hidden)
            for n in _free(e, set()):
                if n not in self.scope:
                    raise CypherError("UndefinedVariable", n)
            sort_keys += v.order(self.ev(e), down)
        self._cut(k, sort_keys, made)

    def _one_aggregate(self, x: Any) -> tuple[Column, T.DataType, Column | None]:
        """(aggregate, type, value over no rows if that isn't NULL)."""
        zero = F.lit(0).cast("long")
        if isinstance(x, t.CountAll):
            return F.count(F.lit(1)), LONG, zero
        if x.name.startswith("percentile"):
            if len(x.args) != 2:
                raise CypherError("InvalidNumberOfArguments", x.name)
            a, p = self.ev(x.args[0]), self.ev(x.args[1])
            if not isinstance(p.const, (int, float)):
                raise CypherError("NonConstantExpression", x.name)
            if not 0 <= p.const <= 1 or math.isnan(p.const):
                raise CypherError("NumberOutOfRange", x.name, "runtime")
            if not v.is_number(a.type):
                return F.max(F.lit(None).cast("double")), v.DOUBLE, None
            if x.name == "percentilecont":
                return F.percentile(a.col.cast("double"), float(p.const)), v.DOUBLE, None
            # the smallest value with at least this share of the values up to it
            name = self.fresh()
            self.frame = self.frame.withColumn(name, a.col)
            return F.expr(f"percentile_disc({float(p.const)!r}) WITHIN GROUP (ORDER BY `{name}`)").cast(a.type), a.type, None
        if len(x.args) != 1:
            raise CypherError("InvalidNumberOfArguments", x.name)
        arg = x.args[0]
        if any(isinstance(y, t.Call) and y.name == "rand" for y in t.walk(arg)):
            raise CypherError("NonConstantExpression", "rand() in an aggregate")
        b = self.scope.get(arg.name) if isinstance(arg, t.Var) else None
        if x.name == "count":
            col = c(b.key) if isinstance(b, (NodeB, RelB)) else self.ev(arg).col
            return (F.countDistinct(col) if x.distinct else F.count(col)), LONG, zero
        a = self.ev(arg)
        if x.name == "sum":
            if v.is_duration(a.type):
                parts = [F.coalesce(F.sum(a.col[p]), zero).alias(p) for p in ("_months", "_days", "_nanos")]
                return F.struct(*parts), a.type, None
            if not v.is_number(a.type):
                return F.coalesce(F.max(F.lit(None).cast("long")), zero), LONG, zero
            empty = F.lit(0).cast(a.type)
            return F.coalesce(F.sum_distinct(a.col) if x.distinct else F.sum(a.col), empty), a.type, empty
        if x.name == "avg":
            if not v.is_number(a.type):
                return F.max(F.lit(None).cast("double")), v.DOUBLE, None
            return (F.sum_distinct(a.col.cast("double")) / F.countDistinct(a.col)) if x.distinct else F.avg(a.col.cast("double")), v.DOUBLE, None
        if x.name in ("min", "max"):
            if a.type == NULL:
                return F.max(F.lit(None).cast("string")), STRING, None
            return (F.min if x.name == "min" else F.max)(a.col), a.type, None
        if a.type == NULL:
            return F.collect_list(F.lit(None).cast("string")), T.ArrayType(STRING), None
        out = F.array_distinct(F.collect_list(a.col)) if x.distinct else F.collect_list(a.col)
        kind = T.ArrayType(a.type)
        return out, kind, F.array().cast(kind)

    # --- running -----------------------------------------------------------------------------

    def run(self, query: t.Query) -> Compiler:
        """All parts; afterwards frame and scope hold the result."""
        if len(query.parts) == 1:
            self.run_clauses(query.parts[0])
            return self
        start = (self.frame, dict(self.scope), self.unit)
        done = []
        for part in query.parts:
            sub = self.child()
            sub.frame, sub.scope, sub.unit = start[0], dict(start[1]), start[2]
            sub.base, sub.imports = self.base, self.imports
            sub.run_clauses(part)
            if sub.outputs is None:
                raise CypherError("InvalidClauseComposition", "each side of UNION returns something")
            done.append(sub)
        if len({tuple(s.outputs) for s in done}) > 1:
            raise CypherError("DifferentColumnsInUnion")
        kinds = []
        for n in done[0].outputs:
            for s in done:
                s.load(n)
            kind: T.DataType = NULL
            for s in done:
                kind = v.merged(kind, s.scope[n].value.type)
            kinds.append(kind)
        made = [self.fresh() for _ in kinds]
        frames = [s.frame.select(*[v.cast(s.scope[n].value, kind).alias(m) for n, kind, m in zip(s.outputs, kinds, made)], *map(c, self.imports)) for s in done]
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        self.frame, self.unit = out if query.all else out.distinct(), False
        self.outputs = done[0].outputs
        self.scope = {n: ValB(m, kind) for n, m, kind in zip(self.outputs, made, kinds)}
        return self

    def run_clauses(self, clauses: tuple) -> None:
        for n, k in enumerate(clauses):
            if isinstance(k, t.Match):
                self.match(k)
            elif isinstance(k, t.Project):
                self.project(k)
            elif isinstance(k, t.Filter):
                if n == 0 or not isinstance(clauses[n - 1], (t.Project, t.CallProcedure)):
                    raise CypherError("InvalidClauseComposition", "WHERE")
                self.filter(k.where)
            elif isinstance(k, t.Unwind):
                self.unwind(k)
            elif isinstance(k, t.CallQuery):
                self.call_query(k)
            elif isinstance(k, t.CallProcedure):
                self.call_procedure(k, len(clauses) == 1)
            elif isinstance(k, t.WRITES):
                self.update(k)
            else:
                raise CypherError("InvalidClauseComposition", type(k).__name__)

    def update(self, k: Any) -> None:
        raise CypherError("InvalidClauseComposition", "an update in a reading query", "execution")

    def result(self) -> DataFrame:
        if self.outputs is None:
            raise CypherError("InvalidClauseComposition", "the query returns nothing")
        for n in self.outputs:
            self.load(n)
        return self.frame.select(*[self.scope[n].value.col.alias(n) for n in self.outputs])


def _settled(kind: T.DataType) -> T.DataType:
    """Void parts as text, so that a column can be written."""
    if kind == NULL:
        return STRING
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_settled(kind.elementType))
    if isinstance(kind, T.StructType) and any(f.dataType == NULL for f in kind.fields):
        return T.StructType([T.StructField(f.name, _settled(f.dataType)) for f in kind.fields])
    return kind


def _extra(sub: Compiler, have: list[str]) -> list[str]:
    """Columns that conditions between levels may use."""
    return [x for x in sub.frame.columns if x not in have and x != "_unit"]


def _swapped(e: Any, with_: dict) -> Any:
    """e with whole subexpressions replaced."""
    if e.__hash__ and not isinstance(e, (str, tuple, int, float, bool, type(None))) and e in with_:
        return with_[e]
    if isinstance(e, tuple):
        return tuple(_swapped(x, with_) for x in e)
    if hasattr(e, "__dataclass_fields__"):
        return type(e)(**{f: _swapped(getattr(e, f), with_) for f in e.__dataclass_fields__})
    return e


def _free(e: Any, bound: set[str]) -> set[str]:
    """Variables of an expression that it doesn't bind itself; what patterns mention isn't looked at."""
    if isinstance(e, t.Var):
        return set() if e.name in bound else {e.name}
    if isinstance(e, (t.Exists, t.PatternTest, t.PatternList)):
        return set()
    if isinstance(e, (t.Comprehension, t.Quantifier)):
        out = _free(e.source, bound)
        for x in (e.where, getattr(e, "value", None)):
            out |= _free(x, bound | {e.var})
        return out
    if isinstance(e, t.Reduce):
        return _free(e.start, bound) | _free(e.source, bound) | _free(e.value, bound | {e.var, e.acc})
    if isinstance(e, tuple):
        return set().union(*[_free(x, bound) for x in e]) if e else set()
    if hasattr(e, "__dataclass_fields__"):
        return set().union(*[_free(getattr(e, f), bound) for f in e.__dataclass_fields__])
    return set()


def run_query(graph: PropertyGraph, text: str, params: dict, **options) -> DataFrame:
    query = parse(text)
    made = Compiler(graph, params, options=options).run(query).result()
    if query.explain:
        plan = made._jdf.queryExecution().explainString(made.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return graph.spark.createDataFrame([(plan,)], "plan string")
    return made
