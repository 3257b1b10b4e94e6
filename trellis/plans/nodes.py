"""Syntax tree. Everything is a frozen value, so that expressions can be compared and used as keys."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    var: str
    key: str


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Un:
    op: str  # not, -, +, isnull, notnull
    arg: object


@dataclass(frozen=True)
class Bin:
    op: str  # + - * / % and or = <> < <= > >=
    left: object
    right: object


@dataclass(frozen=True)
class Agg:
    fn: str
    arg: object  # None: count(*)
    distinct: bool = False


@dataclass(frozen=True)
class Node:
    var: str
    label: str | None = None
    props: tuple = ()
    named: bool = False


@dataclass(frozen=True)
class Rel:
    var: str
    type: str | None = None
    way: str = "both"  # out, in, both
    props: tuple = ()
    low: int | None = None  # None: a plain hop
    high: int | None = None
    named: bool = False


@dataclass(frozen=True)
class Path:
    nodes: tuple
    rels: tuple


@dataclass(frozen=True)
class Match:
    paths: tuple
    where: object = None
    optional: bool = False


@dataclass(frozen=True)
class Item:
    expr: object
    name: str
    aliased: bool = False


@dataclass(frozen=True)
class Project:
    items: tuple  # empty with star
    star: bool = False
    distinct: bool = False
    order: tuple = ()  # (expr, ascending)
    skip: int | None = None
    limit: int | None = None
    where: object = None
    final: bool = False


@dataclass(frozen=True)
class Index:
    label: str
    key: str
    create: bool


def children(e):
    if isinstance(e, Un):
        return (e.arg,)
    if isinstance(e, Bin):
        return (e.left, e.right)
    if isinstance(e, Agg):
        return (e.arg,) if e.arg is not None else ()
    if isinstance(e, Path):
        return tuple(v for n in (*e.nodes, *e.rels) for _, v in n.props)
    return ()


def walk(e):
    if e is None:
        return
    yield e
    for c in children(e):
        yield from walk(c)


def has_agg(e) -> bool:
    return any(isinstance(x, Agg) for x in walk(e))


def names(e) -> set[str]:
    """Variables that an expression speaks of."""
    out = set()
    for x in walk(e):
        if isinstance(x, Var):
            out.add(x.name)
        elif isinstance(x, Prop):
            out.add(x.var)
        elif isinstance(x, Path):
            out |= {n.var for n in x.nodes if n.named}
    return out


def conjuncts(e) -> list:
    if e is None:
        return []
    if isinstance(e, Bin) and e.op == "and":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]
