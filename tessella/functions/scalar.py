"""Cypher's scalar functions as expressions, by lower-case name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cypher.errors import CypherError
from . import temporal
from .values import BOOL, DOUBLE, LONG, NULL, STRING, Val, cast, is_list, is_map, is_node, is_number, is_path, is_rel, lit, list_of, merged, null, text_of

FUNCTIONS: dict[str, tuple[int, int, Callable]] = {}


def function(name: str, least: int = 1, most: int | None = None):
    def keep(f):
        FUNCTIONS[name.lower()] = (least, least if most is None else most, f)
        return f

    return keep


def call(name: str, args: list[Val]) -> Val:
    if name not in FUNCTIONS:
        raise CypherError("UnknownFunction", name)
    least, most, f = FUNCTIONS[name]
    if not least <= len(args) <= most:
        raise CypherError("InvalidNumberOfArguments", name)
    return f(*args)


def _text(v: Val) -> Column | None:
    return v.col if v.type == STRING else None


def _on_text(name: str, f: Callable[[Column], Column], out: T.DataType = STRING) -> None:
    @function(name)
    def go(v: Val) -> Val:
        return Val(f(v.col), out) if v.type == STRING else null(out)


_on_text("toLower", F.lower)
_on_text("toUpper", F.upper)
_on_text("trim", lambda c: F.regexp_replace(c, "(?U)^\\s+|\\s+$", ""))
_on_text("lTrim", lambda c: F.regexp_replace(c, "(?U)^\\s+", ""))
_on_text("rTrim", lambda c: F.regexp_replace(c, "(?U)\\s+$", ""))


@function("substring", 2, 3)
def _substring(s: Val, start: Val, n: Val | None = None) -> Val:
    if s.type != STRING or start.type != LONG:
        return null(STRING)
    size = n.col if n is not None else F.char_length(s.col).cast("long")
    at, size = start.col.cast("int"), F.greatest(F.lit(0), F.least(size, F.lit(2**31 - 1).cast("long")).cast("int"))
    return Val(F.when(s.col.isNull() | start.col.isNull(), None).when(start.col < 0, "").otherwise(F.substring(s.col, at + 1, size)), STRING)


@function("left", 2)
def _left(s: Val, n: Val) -> Val:
    return Val(F.when(n.col <= 0, F.substring(s.col, 1, 0)).otherwise(F.substring(s.col, F.lit(1), F.least(n.col, F.lit(2**31 - 1).cast("long")).cast("int"))), STRING) if s.type == STRING and n.type == LONG else null(STRING)


@function("right", 2)
def _right(s: Val, n: Val) -> Val:
    if s.type != STRING or n.type != LONG:
        return null(STRING)
    size = F.char_length(s.col)
    take = F.least(F.greatest(n.col, F.lit(0).cast("long")), size.cast("long")).cast("int")
    return Val(F.substring(s.col, size - take + 1, take), STRING)


@function("replace", 3)
def _replace(s: Val, a: Val, b: Val) -> Val:
    if not s.type == a.type == b.type == STRING:
        return null(STRING)
    letters = F.when(F.char_length(s.col) == 0, b.col).otherwise(F.concat(b.col, F.regexp_replace(s.col, "(?s)(.)", F.concat(F.lit("$1"), F.regexp_replace(b.col, "([\\\\$])", "\\\\$1")))))
    return Val(F.when(a.col == "", letters).otherwise(F.replace(s.col, a.col, b.col)), STRING)


@function("split", 2)
def _split(s: Val, d: Val) -> Val:
    t = T.ArrayType(STRING)
    if s.type != STRING or d.type != STRING:
        return null(t)
    pieces = F.split(s.col, F.concat(F.lit("\\Q"), d.col, F.lit("\\E")))
    letters = F.when(F.char_length(s.col) == 0, F.array(F.lit(""), F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.split(s.col, ""), F.array(F.lit(""))))
    return Val(F.when(d.col == "", letters).otherwise(pieces), t)


@function("reverse")
def _reverse(v: Val) -> Val:
    return Val(F.reverse(v.col), v.type) if v.type == STRING or is_list(v.type) else null()


@function("toString")
def _to_string(v: Val) -> Val:
    return Val(text_of(v), STRING)


@function("toInteger")
def _to_integer(v: Val) -> Val:
    if v.type == LONG:
        return v
    if v.type == STRING:
        s = F.regexp_replace(v.col, "(?U)^\\s+|\\s+$", "")
        return Val(F.coalesce(s.try_cast("long"), _whole(s.try_cast("double"))), LONG)
    if v.type == DOUBLE:
        return Val(_whole(v.col), LONG)
    if v.type == NULL:
        return null(LONG)
    raise CypherError("InvalidArgumentValue", "toInteger", "runtime")


def _whole(c: Column) -> Column:
    return F.when(F.abs(c) < 9.2e18, F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("long"))


@function("toFloat")
def _to_float(v: Val) -> Val:
    if v.type in (LONG, DOUBLE):
        return Val(v.col.cast("double"), DOUBLE)
    if v.type == STRING:
        x = v.col.try_cast("double")
        return Val(F.when(F.abs(x) < float("inf"), x), DOUBLE)
    if v.type == NULL:
        return null(DOUBLE)
    raise CypherError("InvalidArgumentValue", "toFloat", "runtime")


@function("toBoolean")
def _to_boolean(v: Val) -> Val:
    if v.type == BOOL:
        return v
    if v.type == STRING:
        low = F.lower(F.trim(v.col))
        return Val(F.when(low == "true", True).when(low == "false", False), BOOL)
    if v.type == NULL:
        return null(BOOL)
    raise CypherError("InvalidArgumentValue", "toBoolean", "runtime")


# --- numbers ---------------------------------------------------------------------------------


def _on_number(name: str, f: Callable[[Val], Val]) -> None:
    @function(name)
    def go(v: Val) -> Val:
        return f(v) if is_number(v.type) else null()


_double = lambda f: lambda v: Val(f(v.col.cast("double")), DOUBLE)
_on_number("abs", lambda v: Val(F.when(v.col < 0, F.try_subtract(F.lit(0).cast("long"), v.col)).otherwise(v.col) if v.type == LONG else F.abs(v.col), v.type))
_on_number("sign", lambda v: Val(F.signum(v.col.cast("double")).cast("long"), LONG))
_on_number("ceil", _double(lambda c: F.ceil(c).cast("double")))
_on_number("floor", _double(lambda c: F.floor(c).cast("double")))
_on_number("round", _double(lambda c: F.when(F.abs(c) >= 2.0**52, c).when(c < 0, -F.floor(-c + 0.5).cast("double")).otherwise(F.floor(c + 0.5).cast("double"))))
_on_number("sqrt", _double(lambda c: F.when(c < 0, float("nan")).otherwise(F.sqrt(c))))


@function("log", 1, 2)
def _log(a: Val, b: Val | None = None) -> Val:
    if not is_number(a.type) or b is not None and not is_number(b.type):
        return null(DOUBLE)
    ln = lambda c: F.when(c > 0, F.ln(c.cast("double")))
    if b is None:
        return Val(ln(a.col), DOUBLE)
    return Val(F.when(a.col != 1, F.try_divide(ln(b.col), ln(a.col))), DOUBLE)


function("e", 0)(lambda: Val(F.e(), DOUBLE))
function("pi", 0)(lambda: Val(F.pi(), DOUBLE))
#: A constant, so that results don't change from run to run.
function("rand", 0)(lambda: lit(0.42))

# --- lists and maps --------------------------------------------------------------------------


@function("size")
def _size(v: Val) -> Val:
    if v.type == STRING:
        return Val(F.char_length(v.col).cast("long"), LONG)
    if is_list(v.type):
        return Val(F.when(v.col.isNotNull(), F.size(v.col)).cast("long"), LONG)
    if is_path(v.type):
        raise CypherError("InvalidArgumentType", "size of a path")
    if is_map(v.type) and not temporal.is_temporal(v.type):
        return Val(F.when(v.col.isNotNull(), F.lit(len([f for f in v.type.fieldNames() if f != "_empty"]))).cast("long"), LONG)
    return null(LONG)


@function("head")
def _head(v: Val) -> Val:
    return Val(F.get(v.col, F.lit(0)), v.type.elementType) if is_list(v.type) else null()


@function("last")
def _last(v: Val) -> Val:
    return Val(F.try_element_at(v.col, F.lit(-1)), v.type.elementType) if is_list(v.type) else null()


@function("tail")
def _tail(v: Val) -> Val:
    return Val(F.when(F.size(v.col) == 0, v.col).otherwise(F.slice(v.col, F.lit(2), F.greatest(F.size(v.col), F.lit(1)))), v.type) if is_list(v.type) else null()


def prop_names(t: T.StructType) -> list[str]:
    return [n for n in t.fieldNames() if not n.startswith("_")]


@function("keys")
def _keys(v: Val) -> Val:
    t = T.ArrayType(STRING)
    if not is_map(v.type):
        return null(t)
    if v.fields is not None or not (is_node(v.type) or is_rel(v.type)):
        return Val(F.when(v.col.isNotNull(), list_of([lit(n) for n in v.type.fieldNames() if n != "_empty"]).col.cast("array<string>")), t)
    return Val(F.when(v.col.isNotNull(), F.filter(F.array(*[F.when(v.col[n].isNotNull(), F.lit(n)) for n in prop_names(v.type)] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())), t)


@function("properties")
def _properties(v: Val) -> Val:
    if not is_map(v.type):
        return null()
    if not (is_node(v.type) or is_rel(v.type)):
        return v
    names = prop_names(v.type)
    t = T.StructType([v.type[n] for n in names]) if names else T.StructType([T.StructField("_empty", NULL)])
    return Val(F.when(v.col.isNotNull(), F.struct(*[v.col[n].alias(n) for n in names] or [F.lit(None).alias("_empty")])), t)


@function("range", 2, 3)
def _range(a: Val, b: Val, step: Val | None = None) -> Val:
    t = T.ArrayType(LONG)
    s = step.col if step is not None else F.lit(1).cast("long")
    if a.type != LONG or b.type != LONG or step is not None and step.type != LONG:
        raise CypherError("InvalidArgumentType", "range", "runtime")
    fits = ((s > 0) & (a.col <= b.col)) | ((s < 0) & (a.col >= b.col))
    safe = lambda c: F.when(fits, c)  # noqa: E731  sequence fails on a step of the wrong sign
    return Val(F.when(s == 0, None).when(fits, F.sequence(safe(a.col), safe(b.col), safe(s))).otherwise(F.array().cast("array<bigint>")), t)


@function("coalesce", 1, 1000)
def _coalesce(*args: Val) -> Val:
    t: T.DataType = NULL
    for v in args:
        t = merged(t, v.type)
    return Val(F.coalesce(*[cast(v, t) for v in args]), t)


def index(v: Val, at: Val) -> Val:
    if is_list(v.type):
        if at.type == NULL:
            return null(v.type.elementType)
        if at.type != LONG:
            raise CypherError("InvalidArgumentType", "a list's index")
        i = F.when((at.col >= 0) & (at.col < 2**31 - 1) | (at.col < 0) & (at.col > -(2**31)), at.col).cast("int")
        return Val(F.when(i >= 0, F.get(v.col, i)).otherwise(F.try_element_at(v.col, F.when(i < 0, i))), v.type.elementType)
    if is_map(v.type) and at.type == STRING:
        if isinstance(at.const, str):
            return field(v, at.const)
        t: T.DataType = NULL
        names = [n for n in v.type.fieldNames() if not n.startswith("_")]
        for n in names:
            t = merged(t, v.type[n].dataType)
        out = F.lit(None).cast(t) if t != NULL else F.lit(None)
        for n in names:
            out = F.when(at.col == n, cast(Val(v.col[n], v.type[n].dataType), t)).otherwise(out)
        return Val(out, t)
    if v.type == NULL or at.type == NULL:
        return null()
    raise CypherError("InvalidArgumentType", "an index", "runtime")


def field(v: Val, key: str) -> Val:
    """v.key: a property, a map's value, a temporal part; NULL where there is none."""
    if v.fields is not None and key in v.fields:
        return v.fields[key]
    if temporal.is_temporal(v.type):
        return temporal.accessor(v, key) or null()
    if is_map(v.type):
        return Val(v.col[key], v.type[key].dataType) if key in v.type.fieldNames() and not (key.startswith("_") and (is_node(v.type) or is_rel(v.type))) else null()
    if v.type == NULL:
        return null()
    raise CypherError("InvalidArgumentType", f"{key} of a {v.type.simpleString()}", "runtime")


def cut(v: Val, low: Val | None, high: Val | None) -> Val:
    """v[low..high]: negative ends count from the end."""
    if not (is_list(v.type) or v.type == STRING) or any(x is not None and x.type == NULL for x in (low, high)):
        return null(v.type)
    n = (F.size(v.col) if is_list(v.type) else F.char_length(v.col)).cast("long")
    place = lambda c: F.least(F.greatest(F.when(c < 0, n + c).otherwise(c), F.lit(0).cast("long")), n)
    a = place(low.col) if low is not None else F.lit(0).cast("long")
    b = place(high.col) if high is not None else n
    size = F.greatest(b - a, F.lit(0).cast("long")).cast("int")
    if v.type == STRING:
        return Val(F.substring(v.col, (a + 1).cast("int"), size), STRING)
    none = [x.col.isNull() for x in (low, high) if x is not None] + [v.col.isNull()]
    gone = none[0]
    for x in none[1:]:
        gone = gone | x
    return Val(F.when(gone, None).otherwise(F.slice(v.col, F.coalesce((a + 1).cast("int"), F.lit(1)), F.coalesce(size, F.lit(0)))), v.type)


# --- graph -----------------------------------------------------------------------------------


@function("id")
def _id(v: Val) -> Val:
    return Val(v.col["_id"] if is_node(v.type) else v.col["_rid"], LONG) if is_node(v.type) or is_rel(v.type) else _wrong(v, "id")


def _wrong(v: Val, name: str) -> Val:
    if v.type == NULL:
        return null()
    raise CypherError("InvalidArgumentType", name)


@function("labels")
def _labels(v: Val) -> Val:
    return Val(v.col["_labels"], T.ArrayType(STRING)) if is_node(v.type) else _wrong(v, "labels")


@function("type")
def _type(v: Val) -> Val:
    return Val(v.col["_type"], STRING) if is_rel(v.type) else _wrong(v, "type")


@function("length")
def _length(v: Val) -> Val:
    return Val(F.when(v.col.isNotNull(), F.size(v.col["_rels"])).cast("long"), LONG) if is_path(v.type) else _wrong(v, "length")


@function("nodes")
def _nodes(v: Val) -> Val:
    return Val(v.col["_nodes"], v.type["_nodes"].dataType) if is_path(v.type) else _wrong(v, "nodes")


@function("relationships")
def _relationships(v: Val) -> Val:
    return Val(v.col["_rels"], v.type["_rels"].dataType) if is_path(v.type) else _wrong(v, "relationships")


# --- temporal --------------------------------------------------------------------------------

for _k in ("date", "time", "localtime", "datetime", "localdatetime"):
    function(_k, 0, 1)(lambda *a, k=_k: temporal.construct(k, list(a)))
    function(f"{_k}.truncate", 1, 3)(lambda *a, k=_k: temporal.truncate(k, list(a)))
    for _clock in ("transaction", "statement", "realtime"):
        #: The clocks stand at the epoch, so that results don't change from run to run.
        function(f"{_k}.{_clock}", 0, 1)(lambda *a, k=_k: temporal.construct(k, []))
function("datetime.fromepoch", 1, 2)(lambda *a: temporal.from_epoch(list(a), False))
function("datetime.fromepochmillis", 1)(lambda *a: temporal.from_epoch(list(a), True))
function("duration", 1)(lambda v: temporal.duration([v]))
for _how in ("between", "inmonths", "indays", "inseconds"):
    function(f"duration.{_how}", 2)(lambda a, b, how=_how: temporal.between(how, [a, b]))
