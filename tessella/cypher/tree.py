"""What the parser makes: expressions, patterns and clauses."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    of: Any
    key: str


@dataclass(frozen=True)
class Index:
    of: Any
    at: Any


@dataclass(frozen=True)
class Slice:
    of: Any
    low: Any
    high: Any


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class MapOf:
    items: tuple  # of (key, expression)


@dataclass(frozen=True)
class Unary:
    op: str
    of: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class NullTest:
    of: Any
    negated: bool


@dataclass(frozen=True)
class LabelTest:
    of: Any
    labels: tuple


@dataclass(frozen=True)
class Case:
    whens: tuple  # of (condition, value)
    default: Any


@dataclass(frozen=True)
class Call:
    name: str  # lower case
    args: tuple
    distinct: bool = False


@dataclass(frozen=True)
class CountAll:
    pass


@dataclass(frozen=True)
class Comprehension:
    var: str
    source: Any
    where: Any
    value: Any


@dataclass(frozen=True)
class Quantifier:
    kind: str
    var: str
    source: Any
    where: Any


@dataclass(frozen=True)
class Reduce:
    acc: str
    start: Any
    var: str
    source: Any
    value: Any


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    labels: tuple
    props: Any


@dataclass(frozen=True)
class RelPattern:
    var: str | None
    types: tuple
    way: str  # out, in, both
    props: Any
    hops: tuple | None  # (least, most or None)


@dataclass(frozen=True)
class PathPattern:
    var: str | None
    shortest: str | None  # one, all
    parts: tuple


@dataclass(frozen=True)
class PatternTest:
    pattern: PathPattern


@dataclass(frozen=True)
class PatternList:
    pattern: PathPattern
    where: Any
    value: Any


@dataclass(frozen=True)
class Exists:
    query: Any  # a Query


@dataclass(frozen=True)
class Item:
    value: Any
    name: str
    aliased: bool


@dataclass(frozen=True)
class Order:
    value: Any
    down: bool


@dataclass(frozen=True)
class Match:
    patterns: tuple
    where: Any
    optional: bool


@dataclass(frozen=True)
class Project:
    """RETURN, or WITH (final false)."""

    items: tuple
    star: bool
    distinct: bool
    order: tuple
    skip: Any
    limit: Any
    where: Any
    final: bool


@dataclass(frozen=True)
class Filter:
    """A WHERE after WITH ... LIMIT."""

    where: Any


@dataclass(frozen=True)
class Unwind:
    value: Any
    var: str


@dataclass(frozen=True)
class CallQuery:
    query: Any


@dataclass(frozen=True)
class CallProcedure:
    name: str
    args: tuple | None
    yields: tuple | None  # of (field, alias); () for *


@dataclass(frozen=True)
class Create:
    patterns: tuple


@dataclass(frozen=True)
class Merge:
    pattern: PathPattern
    on_create: tuple
    on_match: tuple


@dataclass(frozen=True)
class SetItem:
    kind: str  # property, replace, add, labels
    var: str
    key: str | None
    value: Any


@dataclass(frozen=True)
class Set:
    items: tuple


@dataclass(frozen=True)
class Remove:
    items: tuple


@dataclass(frozen=True)
class Delete:
    items: tuple
    detach: bool


@dataclass(frozen=True)
class Foreach:
    var: str
    source: Any
    body: tuple


@dataclass(frozen=True)
class Query:
    parts: tuple  # of clause tuples, one for each side of UNION
    all: bool = False
    explain: bool = field(default=False, compare=False)


WRITES = (Create, Merge, Set, Remove, Delete, Foreach)


def walk(x: Any):
    """x and all below it."""
    yield x
    if is_dataclass(x):
        for f in fields(x):
            yield from walk(getattr(x, f.name))
    elif isinstance(x, tuple):
        for y in x:
            yield from walk(y)
