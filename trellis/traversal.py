"""Step-by-step traversals, as a builder of the same clauses that query texts become."""

from __future__ import annotations

from dataclasses import replace

from .plans.compiler import Compiler
from .plans.nodes import Agg, Bin, Item, Lit, Match, Node, Path, Project, Prop, Rel, Var
from .sources.graph import PropertyGraph


def eq(v):
    return "=", v


def neq(v):
    return "<>", v


def lt(v):
    return "<", v


def lte(v):
    return "<=", v


def gt(v):
    return ">", v


def gte(v):
    return ">=", v


class Traversal:
    """Immutable: each step gives a new traversal."""

    def __init__(self, graph: PropertyGraph, nodes=(), rels=(), where=None, items=None, distinct=False, limit=None):
        self.graph, self.nodes, self.rels, self.where, self.items, self.distinct_, self.limit_ = graph, nodes, rels, where, items, distinct, limit

    def _with(self, **kw) -> Traversal:
        now = {"nodes": self.nodes, "rels": self.rels, "where": self.where, "items": self.items, "distinct": self.distinct_, "limit": self.limit_}
        return Traversal(self.graph, **{**now, **kw})

    def V(self, label: str | None = None) -> Traversal:
        return self._with(nodes=(Node("v0", label, (), True),), rels=())

    def _step(self, type_: str | None, way: str) -> Traversal:
        k = len(self.nodes)
        return self._with(nodes=(*self.nodes, Node(f"v{k}", None, (), True)), rels=(*self.rels, Rel(f"e{k}", type_, way)))

    def out(self, type_: str | None = None) -> Traversal:
        return self._step(type_, "out")

    def in_(self, type_: str | None = None) -> Traversal:
        return self._step(type_, "in")

    def both(self, type_: str | None = None) -> Traversal:
        return self._step(type_, "both")

    def has(self, key: str, test) -> Traversal:
        """A property of the vertex where the traversal is; test is a value or eq, neq, lt, lte, gt, gte of one."""
        op, v = test if isinstance(test, tuple) else eq(test)
        c = Bin(op, Prop(self.nodes[-1].var, key), Lit(v))
        return self._with(where=c if self.where is None else Bin("and", self.where, c))

    def has_label(self, label: str) -> Traversal:
        return self._with(nodes=(*self.nodes[:-1], replace(self.nodes[-1], label=label)))

    def values(self, *keys: str) -> Traversal:
        return self._with(items=tuple(Item(Prop(self.nodes[-1].var, k), k, True) for k in keys))

    def dedup(self) -> Traversal:
        return self._with(distinct=True)

    def limit(self, n: int) -> Traversal:
        return self._with(limit=n)

    def _fold(self, fn: str, key: str | None) -> Traversal:
        v = self.nodes[-1].var
        return self._with(items=(Item(Agg(fn, Prop(v, key) if key else Var(v), self.distinct_), fn, True),), distinct=False)

    def count(self) -> Traversal:
        return self._fold("count", None)

    def sum(self, key: str) -> Traversal:
        return self._fold("sum", key)

    def min(self, key: str) -> Traversal:
        return self._fold("min", key)

    def max(self, key: str) -> Traversal:
        return self._fold("max", key)

    def mean(self, key: str) -> Traversal:
        return self._fold("avg", key)

    def to_df(self):
        items = self.items or (Item(Var(self.nodes[-1].var), "v", True),)
        p = Project(items, distinct=self.distinct_, limit=self.limit_, final=True)
        return Compiler(self.graph).compile((Match((Path(self.nodes, self.rels),), self.where), p))


def traverse(graph: PropertyGraph) -> Traversal:
    return Traversal(graph)
