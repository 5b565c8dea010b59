"""Typed columns and Cypher's rules for equality, order, numbers and text, all in built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cypher.errors import CypherError

LONG, DOUBLE, STRING, BOOL, NULL, DATE, LOCAL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType(), T.DateType(), T.TimestampNTZType()


@dataclass(frozen=True)
class Val:
    """A column with its type; `const` is the value of a literal, `entity` names a node or relationship kind."""

    col: Column
    type: T.DataType
    const: object = None
    fields: dict | None = None  # of a map literal: key to Val


def null(of: T.DataType = NULL) -> Val:
    return Val(F.lit(None).cast(of) if of != NULL else F.lit(None), of)


def lit(x) -> Val:
    if x is None:
        return null()
    if isinstance(x, bool):
        return Val(F.lit(x), BOOL, x)
    if isinstance(x, int):
        return Val(F.lit(x).cast("long"), LONG, x)
    if isinstance(x, float):
        return Val(F.lit(x), DOUBLE, x)
    if isinstance(x, str):
        return Val(F.lit(x), STRING, x)
    if isinstance(x, (list, tuple)):
        return list_of([lit(y) for y in x])
    if isinstance(x, dict):
        return map_of({k: lit(v) for k, v in x.items()})
    import datetime

    if isinstance(x, datetime.datetime):
        return Val(F.lit(x.replace(tzinfo=None)).cast("timestamp_ntz"), LOCAL)
    if isinstance(x, datetime.date):
        return Val(F.lit(x), DATE)
    raise CypherError("InvalidArgumentType", f"a parameter of {type(x).__name__}")


def is_number(t: T.DataType) -> bool:
    return isinstance(t, (T.LongType, T.DoubleType))


def is_list(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)


def is_map(t: T.DataType) -> bool:
    return isinstance(t, T.StructType)


def field_names(t: T.DataType) -> list[str]:
    return t.fieldNames() if isinstance(t, T.StructType) else []


def is_node(t: T.DataType) -> bool:
    return field_names(t)[:2] == ["_id", "_labels"]


def is_rel(t: T.DataType) -> bool:
    return field_names(t)[:2] == ["_rid", "_type"]


def is_path(t: T.DataType) -> bool:
    return field_names(t) == ["_nodes", "_rels"]


def is_duration(t: T.DataType) -> bool:
    return field_names(t) == ["_months", "_days", "_nanos"]


def merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both; text where they have nothing in common."""
    if a == b or b == NULL:
        return a
    if a == NULL:
        return b
    if is_number(a) and is_number(b):
        return DOUBLE
    if is_list(a) and is_list(b):
        return T.ArrayType(merged(a.elementType, b.elementType))
    if is_map(a) and is_map(b):
        out = T.StructType()
        for f in [*a.fields, *[f for f in b.fields if f.name not in a.fieldNames()]]:
            other = b[f.name].dataType if f.name in b.fieldNames() else NULL
            out = out.add(f.name, merged(f.dataType, other))
        return out
    return STRING


def cast(v: Val, to: T.DataType) -> Column:
    """v as a wider type."""
    if v.type == to:
        return v.col
    if v.type == NULL:
        return F.lit(None).cast(to)
    if is_list(to) and is_list(v.type):
        return F.transform(v.col, lambda x: cast(Val(x, v.type.elementType), to.elementType))
    if is_map(to) and is_map(v.type):
        parts = [(cast(Val(v.col[f.name], v.type[f.name].dataType), f.dataType) if f.name in v.type.fieldNames() else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields]
        return F.when(v.col.isNotNull(), F.struct(*parts))
    if to == STRING and v.type != STRING:
        return text_of(v)
    return v.col.cast(to)


def list_of(items: list[Val]) -> Val:
    t: T.DataType = NULL
    for v in items:
        t = merged(t, v.type)
    if not items:
        return Val(F.array(), T.ArrayType(NULL))
    return Val(F.array(*[cast(v, t) for v in items]), T.ArrayType(t))


def map_of(fields: dict[str, Val]) -> Val:
    t = T.StructType([T.StructField(k, v.type) for k, v in fields.items()])
    if not fields:
        return Val(F.struct(F.lit(None).alias("_empty")), T.StructType([T.StructField("_empty", NULL)]), fields={})
    return Val(F.struct(*[v.col.alias(k) for k, v in fields.items()]), t, fields=fields)


def _either_null(a: Val, b: Val, value: bool | None) -> Val:
    return Val(F.when(a.col.isNull() | b.col.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(value).cast("boolean")), BOOL)


def equal(a: Val, b: Val) -> Val:
    """Three-valued equality: NaN equals nothing, lists and maps by their parts, other kinds differ."""
    if a.type == NULL or b.type == NULL:
        return null(BOOL)
    if is_number(a.type) and is_number(b.type):
        same = a.col == b.col
        nan = [F.isnan(v.col) for v in (a, b) if v.type == DOUBLE and not (isinstance(v.const, float) and v.const == v.const)]
        for n in nan:
            same = F.when(n & a.col.isNotNull() & b.col.isNotNull(), False).otherwise(same)
        return Val(same, BOOL)
    for test, key in ((is_node, "_id"), (is_rel, "_rid")):
        if test(a.type) and test(b.type):
            return Val(a.col[key] == b.col[key], BOOL)
    if is_list(a.type) and is_list(b.type):
        parts = F.zip_with(a.col, b.col, lambda x, y: equal(Val(x, a.type.elementType), Val(y, b.type.elementType)).col.cast("boolean"))
        return Val(F.when(F.size(a.col) != F.size(b.col), False).when(a.col.isNull() | b.col.isNull(), None).otherwise(F.forall(parts, lambda x: x)), BOOL)
    if is_map(a.type) and is_map(b.type):
        if set(field_names(a.type)) != set(field_names(b.type)):
            return _either_null(a, b, False)
        out = F.lit(True)
        for f in a.type.fields:
            out = out & equal(Val(a.col[f.name], f.dataType), Val(b.col[f.name], b.type[f.name].dataType)).col
        return Val(F.when(a.col.isNull() | b.col.isNull(), None).otherwise(out), BOOL)
    if a.type == b.type:
        return Val(a.col == b.col, BOOL)
    if {type(a.type), type(b.type)} == {T.DateType, T.TimestampNTZType}:
        return _either_null(a, b, False)
    return _either_null(a, b, False)


def compare(op: str, a: Val, b: Val) -> Val:
    """<, <=, >, >=: NULL across kinds, false with NaN."""
    def go(x: Column, y: Column) -> Column:
        return x < y if op == "<" else x <= y if op == "<=" else x > y if op == ">" else x >= y

    if is_number(a.type) and is_number(b.type):
        out = go(a.col, b.col)
        for v in (a, b):
            if v.type == DOUBLE and not isinstance(v.const, float):
                out = F.when(F.isnan(v.col) & a.col.isNotNull() & b.col.isNotNull(), False).otherwise(out)
        return Val(out, BOOL)
    if a.type == b.type and isinstance(a.type, (T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType)) or is_list(a.type) and a.type == b.type:
        return Val(go(a.col, b.col), BOOL)
    if a.type == b.type and field_names(a.type)[:1] in (["_dt"], ["_tm"], ["_lt"]):
        from .temporal import sort_key

        return Val(go(sort_key(a), sort_key(b)), BOOL)
    return null(BOOL)


def member(x: Val, of: Val) -> Val:
    if of.type == NULL:
        return null(BOOL)
    if not is_list(of.type):
        raise CypherError("InvalidArgumentType", "IN takes a list")
    if of.type.elementType == NULL and x.type == NULL:
        return Val(F.when(F.size(of.col) == 0, False), BOOL)
    hit = F.exists(of.col, lambda y: equal(x, Val(y, of.type.elementType)).col.cast("boolean"))
    return Val(F.when(of.col.isNull(), None).when(F.size(of.col) == 0, False).otherwise(hit), BOOL)


def bool_of(v: Val) -> Column:
    """For AND, OR, NOT: what isn't Boolean is NULL."""
    return v.col if v.type == BOOL else F.lit(None).cast("boolean")


def text_of(v: Val) -> Column:
    """toString: whole doubles without a point, temporal values in ISO form."""
    if v.type == STRING:
        return v.col
    if v.type == DOUBLE:
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
        return F.when(F.isnan(v.col), "NaN").when(whole, v.col.cast("long").cast("string")).when(F.abs(v.col) == float("inf"), F.when(v.col > 0, "inf").otherwise("-inf")).otherwise(v.col.cast("string"))
    if v.type in (LONG, BOOL):
        return v.col.cast("string")
    if v.type == NULL:
        return F.lit(None).cast("string")
    if is_list(v.type) or is_node(v.type) or is_rel(v.type) or is_path(v.type):
        raise CypherError("InvalidArgumentValue", "toString of a list or an entity", "runtime")
    from .temporal import iso_text, is_temporal

    if is_temporal(v.type):
        return iso_text(v)
    raise CypherError("InvalidArgumentValue", "toString of a map", "runtime")


def let(args: list[Val], f) -> Val:
    """f(args) with each argument computed once, however often f's expression uses it."""
    kinds, parts = [], {}
    for i, a in enumerate(args):
        for k, x in (a.fields or {}).items() if a.fields is not None else [(None, a)]:
            if x.type != NULL and x.fields is None:
                parts[(i, k)] = (f"_{len(parts)}", x)
    if not parts:
        return f(args)

    def body(s: Column) -> Column:
        new = []
        for i, a in enumerate(args):
            if a.fields is not None:
                fields = {k: Val(s[parts[(i, k)][0]], x.type, x.const) if (i, k) in parts else x for k, x in a.fields.items()}
                new.append(Val(a.col, a.type, a.const, fields))
            else:
                new.append(Val(s[parts[(i, None)][0]], a.type, a.const) if (i, None) in parts else a)
        r = f(new)
        kinds.append(r.type)
        return r.col

    out = F.get(F.transform(F.array(F.struct(*[x.col.alias(n) for n, x in parts.values()])), body), F.lit(0))
    return Val(out, kinds[0])


# --- arithmetic ------------------------------------------------------------------------------


def add(a: Val, b: Val) -> Val:
    from . import temporal

    if a.type == NULL and not is_list(b.type) or b.type == NULL and not is_list(a.type):
        return null()
    if is_list(a.type) and is_list(b.type):
        t = merged(a.type, b.type)
        return Val(F.concat(cast(a, t), cast(b, t)), t)
    if is_list(a.type) or is_list(b.type):
        whole, one, last = (a, b, True) if is_list(a.type) else (b, a, False)
        t = T.ArrayType(merged(whole.type.elementType, one.type))
        item = F.array(cast(one, t.elementType))
        return Val(F.concat(cast(whole, t), item) if last else F.concat(item, cast(whole, t)), t)
    if a.type == STRING and b.type == STRING:
        return Val(F.concat(a.col, b.col), STRING)
    if temporal.is_temporal(a.type) or temporal.is_temporal(b.type):
        return temporal.plus(a, b, 1)
    return number("+", a, b)


def number(op: str, a: Val, b: Val) -> Val:
    from . import temporal

    if a.type == NULL or b.type == NULL:
        return null()
    if op == "-" and temporal.is_temporal(a.type):
        return temporal.plus(a, b, -1)
    if op in "*/" and (is_duration(a.type) or is_duration(b.type)):
        return temporal.scaled(op, a, b)
    if not (is_number(a.type) and is_number(b.type)):
        return null()
    x, y = a.col, b.col
    if op == "^":
        return Val(F.pow(x.cast("double"), y.cast("double")), DOUBLE)
    if a.type == LONG and b.type == LONG:
        if op in "+-*":
            return Val({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y), LONG)
        if op == "/":
            return Val(_div(x, y), LONG)
        return Val(F.when(y != 0, F.try_mod(x, y)), LONG)
    x, y = x.cast("double"), y.cast("double")
    if op == "/":
        zero = F.when(F.isnan(x) | (x == 0), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
        return Val(F.when(x.isNull() | y.isNull(), None).when(y == 0, zero).otherwise(F.try_divide(x, y)), DOUBLE)
    if op == "%":
        return Val(F.when(y == 0, None).otherwise(F.try_mod(x, y)), DOUBLE)
    return Val(x + y if op == "+" else x - y if op == "-" else x * y, DOUBLE)


def _div(x: Column, y: Column) -> Column:
    """Whole division towards zero; NULL for zero and for the one quotient that doesn't fit."""
    low = F.lit(-(2**63)).cast("long")
    return F.when((y == 0) | (x == low) & (y == -1), None).otherwise(F.call_function("div", x, F.when((y != 0) & ~((x == low) & (y == -1)), y)))


def negative(v: Val) -> Val:
    if v.type == LONG:
        return Val(F.try_subtract(F.lit(0).cast("long"), v.col), LONG)
    if v.type == DOUBLE:
        return Val(-v.col, DOUBLE)
    if is_duration(v.type):
        from . import temporal

        return temporal.scaled("*", v, lit(-1))
    return null()


# --- order -----------------------------------------------------------------------------------


def order(v: Val, down: bool) -> list[Column]:
    """Sort keys: NULL is the largest value."""
    from .temporal import is_temporal, sort_key

    if is_node(v.type):
        keys = [v.col["_id"]]
    elif is_rel(v.type):
        keys = [v.col["_rid"]]
    elif is_temporal(v.type):
        keys = [sort_key(v)]
    elif v.type == NULL:
        return []
    else:
        keys = [v.col]
    return [k.desc_nulls_first() if down else k.asc_nulls_last() for k in keys]
