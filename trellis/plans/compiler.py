"""Clauses to DataFrames.

A bound node variable v is a column v__id, a label that is known here or lies in v__label, and v__p_<property> for each
property that the query speaks of. Other variables are single columns named v__v. The order of expands is ours (Catalyst
doesn't reorder joins without statistics): start where filters are strongest, then always take the relationship whose
far end is bound or else most filtered; one that leads from few vertices to many, as from a nation to its customers, waits
for those that may bind its far end.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import log10

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SemanticProblem
from ..functions import scalar as S
from ..operators import graph_ops as O
from ..sources.graph import PropertyGraph
from . import checks
from .nodes import Agg, Bin, Item, Lit, Node, Param, Path, Project, Prop, Rel, Un, Var, conjuncts, has_agg, names, walk

MAX_HOPS = 255  # of a walk without an upper bound; a longer one is an error

BACK = {"out": "in", "in": "out", "both": "both"}


@dataclass(frozen=True)
class Bound:
    kind: str  # node, edge, or a scalar kind
    labels: frozenset[str] = frozenset()  # of nodes
    props: tuple[tuple[str, str], ...] = ()  # property -> kind


@dataclass
class State:
    df: DataFrame | None = None
    vars: dict[str, Bound] = field(default_factory=dict)


class Compiler:
    def __init__(self, graph: PropertyGraph, params: dict | None = None, into: str = "join", max_hops: int = MAX_HOPS):
        self.g, self.params, self.into, self.max_hops = graph, params or {}, into, max_hops
        self.fresh = 0
        self.later: set[str] | None = None  # variables that the clauses after this one speak of; None: all
        self.picked = False  # the rows grow from vertices that an equality picks
        self.counted = False  # aggregates count rows by __n

    def name(self, base: str) -> str:
        self.fresh += 1
        return f"__{base}{self.fresh}"

    # what the query speaks of

    def compile(self, clauses: tuple) -> DataFrame:
        clauses = tuple(self._bind(c) for c in clauses)
        self.needs: dict[str, set[str]] = {}
        for c in clauses:
            for e in self._exprs(c):
                for x in walk(e):
                    if isinstance(x, Prop):
                        self.needs.setdefault(x.var, set()).add(x.key)
            for n in [n for p in getattr(c, "paths", ()) for n in p.nodes if n.props]:
                self.needs.setdefault(n.var, set()).update(k for k, _ in n.props)
        for c in reversed(clauses):  # n AS m: what is asked of m is asked of n
            if isinstance(c, Project):
                for i in c.items:
                    if isinstance(i.expr, Var) and i.name in self.needs:
                        self.needs.setdefault(i.expr.name, set()).update(self.needs[i.name])
        state, seen = State(), set()
        merged = []
        for c in clauses:
            if not isinstance(c, Project) and merged and not isinstance(merged[-1], Project) and not c.optional and not merged[-1].optional:
                both = [w for w in (merged[-1].where, c.where) if w is not None]
                merged[-1] = replace(c, paths=merged[-1].paths + c.paths, where=Bin("and", *both) if len(both) == 2 else both[0] if both else None)
            else:
                merged.append(c)
        for i, c in enumerate(merged):
            self.later = self._spoken(merged[i + 1 :])
            if isinstance(c, Project):
                state, seen = self.project(state, c), set()
            else:
                checks.check_rels(c.paths, seen)
                if c.where is not None:
                    checks.check_where(c.where)
                state = self.optional(state, c) if c.optional else self.match(state, c.paths, c.where)
        return state.df

    def _exprs(self, c):
        if isinstance(c, Project):
            return [i.expr for i in c.items] + [e for e, _ in c.order] + ([c.where] if c.where is not None else [])
        return ([c.where] if c.where is not None else []) + list(c.paths)

    def _spoken(self, clauses) -> set[str] | None:
        """The variables that clauses speak of, as far as the next projection; None where that returns all."""
        out = set()
        for c in clauses:
            out |= {x for e in self._exprs(c) for x in names(e)} | {n.var for p in getattr(c, "paths", ()) for n in p.nodes}
            if isinstance(c, Project):
                return None if c.star else out
        return out

    def _bind(self, x):
        """Parameters become literals."""
        if isinstance(x, Param):
            if x.name not in self.params:
                raise SemanticProblem(f"no value for ${x.name}")
            return Lit(self.params[x.name])
        if isinstance(x, tuple):
            return tuple(self._bind(y) for y in x)
        if hasattr(x, "__dataclass_fields__"):
            return type(x)(**{f: self._bind(getattr(x, f)) for f in x.__dataclass_fields__})
        return x

    # expressions

    def expr(self, e, st: State, marks: dict | None = None) -> S.Typed:
        if isinstance(e, Lit):
            return S.literal(e.value)
        if isinstance(e, Var):
            b = st.vars.get(e.name)
            if b is None:
                raise SemanticProblem(f"unknown variable {e.name}")
            if b.kind == "node":
                if len(b.labels) == 1:
                    return F.col(f"{e.name}__id"), "node"
                i = F.col(f"{e.name}__id")
                return F.when(i.isNotNull(), F.struct(F.col(f"{e.name}__label").alias("label"), i.alias("id"))), "node"
            if b.kind == "edge":
                raise SemanticProblem(f"relationship {e.name} is no value")
            return F.col(f"{e.name}__v"), b.kind
        if isinstance(e, Prop):
            b = st.vars.get(e.var)
            if b is None:
                raise SemanticProblem(f"unknown variable {e.var}")
            if b.kind not in ("node", "edge"):
                raise SemanticProblem(f"{e.var} has no properties")
            if e.key == "label" and b.kind == "node":
                only = F.lit(next(iter(b.labels))) if len(b.labels) == 1 else F.col(f"{e.var}__label")
                return F.when(F.col(f"{e.var}__id").isNotNull(), only), "string"
            kind = dict(b.props).get(e.key)
            return (F.col(f"{e.var}__p_{e.key}"), kind) if kind else S.null()
        if isinstance(e, Path):
            return F.col(marks[e]), "bool"
        if isinstance(e, Agg):
            if self.counted and e.fn == "count" and not e.distinct:
                n = F.col("__n") if e.arg is None else F.when(self.expr(e.arg, st, marks)[0].isNotNull(), F.col("__n"))
                return F.coalesce(F.sum(n), F.lit(0).cast("long")), "int"
            return S.aggregate(e.fn, None if e.arg is None else self.expr(e.arg, st, marks), e.distinct)
        if isinstance(e, Un):
            return S.unary(e.op, self.expr(e.arg, st, marks))
        x, y = self.expr(e.left, st, marks), self.expr(e.right, st, marks)
        if e.op in ("and", "or"):
            a, b = S.as_bool(x), S.as_bool(y)
            return (a & b if e.op == "and" else a | b), "bool"
        return S.compare(e.op, x, y) if e.op in ("=", "<>", "<", "<=", ">", ">=") else S.arithmetic(e.op, x, y)

    def where(self, st: State, e) -> State:
        """Filter rows. A pattern that stands alone is a semi join, under NOT an anti join, elsewhere a mark."""
        df, rest = st.df, []
        for c in conjuncts(e):
            if isinstance(c, Path):
                df = O.exists(df, *self.pattern_keys(st, c), "left_semi")
            elif isinstance(c, Un) and c.op == "not" and isinstance(c.arg, Path):
                df = O.exists(df, *self.pattern_keys(st, c.arg), "left_anti")
            else:
                rest.append(c)
        out = State(df, st.vars)
        for c in rest:
            marks = {p: self.name("mark") for p in dict.fromkeys(x for x in walk(c) if isinstance(x, Path))}
            for p, m in marks.items():
                out = State(O.mark(out.df, *self.pattern_keys(st, p), m), st.vars)
            keep = out.df.filter(S.as_bool(self.expr(c, out, marks)))
            out = State(keep.drop(*marks.values()), st.vars)
        return out

    def pattern_keys(self, st: State, p: Path):
        """The key columns of the bound variables for which the pattern holds, and how they pair with those of st."""
        shared = [n.var for n in p.nodes if n.named]
        if any(v not in st.vars for v in shared):
            raise SemanticProblem("a pattern in WHERE can't bind variables")
        if not shared:
            raise SemanticProblem("a pattern in WHERE needs a bound variable")
        nodes = tuple(replace(n, var=f"{n.var}") for n in p.nodes)
        narrow = {v: st.vars[v].labels for v in shared}
        saved = self.needs, self.later, self.picked
        self.needs, self.later, self.picked = {}, set(shared), False
        inner = self.match(State(), (Path(nodes, p.rels),), None, narrow)
        self.needs, self.later, self.picked = saved
        pairs, cols = [], []
        for v in dict.fromkeys(shared):
            k = self.name(v)
            cols.append(F.col(f"{v}__id").alias(k))
            pairs.append((f"{v}__id", k))
            if len(st.vars[v].labels) > 1:
                lab = F.col(f"{v}__label") if len(inner.vars[v].labels) > 1 else F.lit(next(iter(inner.vars[v].labels), ""))
                cols.append(lab.alias(k + "l"))
                pairs.append((f"{v}__label", k + "l"))
        return inner.df.select(*cols), pairs

    # patterns

    def match(self, st: State, paths: tuple, where, narrow: dict | None = None) -> State:
        nodes: dict[str, Node] = {}
        for p in paths:
            for n in p.nodes:
                if n.var in nodes:
                    old = nodes[n.var]
                    if old.label and n.label and old.label != n.label:
                        nodes[n.var] = replace(old, label="")  # no vertex has two labels
                    else:
                        nodes[n.var] = replace(old, label=old.label or n.label, props=old.props + n.props)
                else:
                    nodes[n.var] = n
                if n.var in st.vars and st.vars[n.var].kind != "node":
                    raise SemanticProblem(f"{n.var} is no node")
        rels = [(p.nodes[i].var, r, p.nodes[i + 1].var) for p in paths for i, r in enumerate(p.rels)]
        for _, r, _ in rels:
            if r.var in st.vars or r.var in nodes:
                raise SemanticProblem(f"{r.var} is bound already")
        labels = self.possible_labels(st, nodes, rels, narrow or {})
        for v, n in nodes.items():
            if n.props:
                self.needs.setdefault(v, set()).update(k for k, _ in n.props)
        strength = {v: self.strength(v, n, where) for v, n in nodes.items()}
        left, bound, cur = list(rels), {v for v in nodes if v in st.vars}, st
        for v in sorted(bound):
            cur = self.restrict(cur, nodes[v], labels[v])
        while True:
            if not bound or not any(a in bound or b in bound for a, _, b in left):
                free = [v for v in nodes if v not in bound]
                if not free:
                    break
                v = max(free, key=lambda v: (strength[v], -list(nodes).index(v)))
                self.picked = strength[v] >= 10 and (cur.df is None or self.picked)
                cur = self.scan(cur, nodes[v], labels[v], self.filtered(v, nodes[v], where))
                bound.add(v)
                continue
            ready = [t for t in left if t[0] in bound or t[2] in bound]

            def rank(t):
                far = t[2] if t[0] in bound else t[0]
                if t[0] in bound and t[2] in bound:
                    return 1000 - 5 * (t[1].low is not None)
                near = t[0] if far == t[2] else t[2]
                way = t[1].way if far == t[2] else BACK[t[1].way]
                fan = self.g.fan_out(t[1].type, way, labels[near], labels[far]) if len(ready) > 1 else 1
                return strength[far] - 5 * (t[1].low is not None) - 3 * log10(max(fan, 1))

            t = max(ready, key=rank)
            left.remove(t)
            a, r, b = t
            flip = a not in bound
            if flip:
                a, b = b, a
                r = replace(r, way=BACK[r.way])
            live = None
            if self.later is not None:
                live = self.later | names(where) | {x for y, _, z in left for x in (y, z)} | {x for p in paths for x in names(replace(p, nodes=tuple(replace(n, named=False) for n in p.nodes)))} | ({b} if b in bound else set())
            cur = self.walk_(cur, a, r, b, nodes, labels, b in bound, live) if r.low is not None else self.hop(cur, a, r, b, nodes, labels, b in bound)
            bound.add(b)
        return self.where(cur, where) if where is not None else cur

    def possible_labels(self, st, nodes, rels, narrow) -> dict[str, frozenset]:
        every = frozenset(self.g.vertices)
        out = {}
        for v, n in nodes.items():
            s = every if n.label is None else every & {n.label}
            if v in st.vars:
                s &= st.vars[v].labels
            out[v] = s & narrow[v] if v in narrow else s
        for _ in range(len(rels) + 1):
            for a, r, b in rels:
                if r.low == 0:
                    continue
                ends = set()
                for e in self.g.edge_defs(r.type):
                    if r.way in ("out", "both"):
                        ends.add((e.src_label, e.dst_label))
                    if r.way in ("in", "both"):
                        ends.add((e.dst_label, e.src_label))
                if r.low is None:
                    ok = {(x, y) for x, y in ends if x in out[a] and y in out[b]}
                    out[a], out[b] = out[a] & {x for x, _ in ok}, out[b] & {y for _, y in ok}
                else:
                    out[a], out[b] = out[a] & {x for x, _ in ends}, out[b] & {y for _, y in ends}
        return out

    def filtered(self, v: str, n: Node, where) -> frozenset[str]:
        keys = {k for k, _ in n.props}
        for c in conjuncts(where):
            if names(c) == {v}:
                keys |= {x.key for x in walk(c) if isinstance(x, Prop)}
        return frozenset(keys)

    def strength(self, v: str, n: Node, where) -> int:
        s = (1 if n.label else 0) + 10 * len(n.props)
        for c in conjuncts(where):
            if names(c) == {v} and not any(isinstance(x, Path) for x in walk(c)):
                s += 10 if isinstance(c, Bin) and c.op == "=" else 2
        return s

    def vertex_rows(self, v: str, labels: frozenset, keys: frozenset[str] = frozenset()) -> tuple[DataFrame, Bound]:
        """v__id, v__label and the properties needed, of all vertices of these labels."""
        need = sorted(self.needs.get(v, set()) - {"label"})
        kinds = {}
        for p in need:
            ks = {k for k in (self.g.type_of(x, p) for x in labels) if k}
            if ks:
                kinds[p] = ks.pop() if len(ks) == 1 else "float" if ks == {"int", "float"} else "string"
        cast = {"int": "bigint", "float": "double", "string": "string", "bool": "boolean"}
        parts = []
        for x in sorted(labels):
            df = self.g.scan(x, keys)
            cols = [(F.col(p).cast(cast[k]) if p in df.columns else F.lit(None).cast(cast[k])).alias(f"{v}__p_{p}") for p, k in kinds.items()]
            parts.append(df.select(F.col("__id").alias(f"{v}__id"), F.lit(x).alias(f"{v}__label"), *cols))
        if not parts:
            none = ", ".join([f"`{v}__id` bigint", f"`{v}__label` string", *[f"`{v}__p_{p}` {cast[k]}" for p, k in kinds.items()]])
            return self.g.spark.createDataFrame([], none), Bound("node", labels, tuple(kinds.items()))
        df = parts[0]
        for p in parts[1:]:
            df = df.unionAll(p)
        return df, Bound("node", labels, tuple(kinds.items()))

    def scan(self, st: State, n: Node, labels: frozenset, keys: frozenset[str]) -> State:
        df, b = self.vertex_rows(n.var, labels, keys)
        out = State(df if st.df is None else st.df.crossJoin(df), {**st.vars, n.var: b})
        return self.map_filter(out, n)

    def restrict(self, st: State, n: Node, labels: frozenset) -> State:
        """Label and property map of a node that was bound before."""
        b = st.vars[n.var]
        df = st.df
        if labels != b.labels:
            df = df.filter(F.col(f"{n.var}__label").isin(*labels) if labels else F.lit(False))
        return self.map_filter(State(df, {**st.vars, n.var: replace(b, labels=labels)}), n)

    def map_filter(self, st: State, n) -> State:
        df = st.df
        for k, v in n.props:
            b = st.vars[n.var]
            kind = dict(b.props).get(k)
            x = (F.col(f"{n.var}__p_{k}"), kind) if kind else S.null()
            df = df.filter(S.compare("=", x, self.expr(v, st))[0])
        return State(df, st.vars)

    def hop(self, st: State, a: str, r: Rel, b: str, nodes, labels, closing: bool) -> State:
        e = self.name("e")
        need = tuple(sorted(self.needs.get(r.var, set()) | {k for k, _ in r.props}))
        rows = O.edge_rows(self.g.edge_defs(r.type), r.way, set(labels[a]), set(labels[b]), need, e)
        if rows is None:
            return self.nothing(st, r, b, nodes, labels, closing)
        on = [(f"{a}__id", f"{e}__s")]
        if len(labels[a]) > 1:
            on.append((f"{a}__label", f"{e}__sl"))
        if closing:
            on.append((f"{b}__id", f"{e}__d"))
            if len(labels[b]) > 1:
                on.append((f"{b}__label", f"{e}__dl"))
            if self.into == "exists" and not need:
                return State(O.exists(st.df, rows.select(*[y for _, y in on]), on, "left_semi"), st.vars)
        df = st.df
        if self.picked and any(d.large for d in self.g.edge_defs(r.type) if {d.src_label, d.dst_label} <= labels[a] | labels[b]):
            df, small = O.few(df)
            df = F.broadcast(df) if small else df
        df = O.expand(df, rows, on)
        vars_ = dict(st.vars)
        if need:
            kinds = {}
            for d in self.g.edge_defs(r.type):
                for p in need:
                    if p in d.df.columns:
                        kinds[p] = {"bigint": "int", "double": "float", "string": "string", "boolean": "bool"}[d.df.schema[p].dataType.simpleString()]
            for p in need:
                df = df.withColumnRenamed(f"{e}__p_{p}", f"{r.var}__p_{p}")
            vars_[r.var] = Bound("edge", frozenset(), tuple(kinds.items()))
        elif r.named:
            vars_[r.var] = Bound("edge")
        out = State(df, vars_)
        if not closing:
            out = self.arrive(out, f"{e}__d", f"{e}__dl", nodes[b], labels[b])
        out = State(out.df.drop(f"{e}__s", f"{e}__sl", f"{e}__d", f"{e}__dl"), out.vars)
        return self.map_filter(out, r) if r.props else out

    def arrive(self, st: State, id_col: str, label_col: str, n: Node, labels: frozenset) -> State:
        """Bind the node that was reached: its id is on the edge; its table is read only for properties."""
        v = n.var
        if not self.needs.get(v, set()) - {"label"} and not n.props:
            df = st.df.withColumn(f"{v}__id", F.col(id_col)).withColumn(f"{v}__label", F.col(label_col))
            return State(df, {**st.vars, v: Bound("node", labels)})
        keys = {k for k, _ in n.props}
        self.needs.setdefault(v, set()).update(keys)
        rows, bound = self.vertex_rows(v, labels)
        on = [(id_col, f"{v}__id")] + ([(label_col, f"{v}__label")] if len(labels) > 1 else [])
        return self.map_filter(State(O.expand(st.df, rows, on), {**st.vars, v: bound}), n)

    def walk_(self, st: State, a: str, r: Rel, b: str, nodes, labels, closing: bool, live: set[str] | None) -> State:
        """live: variables that are spoken of after the walk. Where its start isn't, walks are counted, not listed."""
        if r.props or self.needs.get(r.var):
            raise SemanticProblem("properties of a walk of several relationships")
        defs = self.g.edge_defs(r.type)
        every = {x for d in defs for x in (d.src_label, d.dst_label)}
        end, end_label = self.name("end"), self.name("endl")
        src_label = self.name("sl")
        df = st.df.withColumn(src_label, F.col(f"{a}__label"))
        gone = {v for v in st.vars if v not in live} if live is not None and a not in live else set()
        of = lambda c, vs: any(c.startswith(f"{v}__") for v in vs)
        dead = tuple(c for c in df.columns if c == src_label or of(c, gone) and not of(c, st.vars.keys() - gone)) if gone else ()
        if r.high == -1:
            w = O.open_walks(df, f"{a}__id", src_label, O.edge_rows(defs, r.way, every, every, (), "__w"), r.low, self.max_hops, end, end_label, dead).drop(src_label)
        else:
            w = O.walks(df, f"{a}__id", src_label, lambda k: O.edge_rows(defs, r.way, every, every, (), f"__w{k}"), r.low, r.high, end, end_label, every, dead, any(d.large for d in defs), self.picked).drop(src_label)
        st = State(w, {v: x for v, x in st.vars.items() if v not in gone})
        want = labels[b] if labels[b] else frozenset()
        if want != frozenset(every):
            w = w.filter(F.col(end_label).isin(*want) if want else F.lit(False))
        out = State(w, dict(st.vars))
        if closing:
            same = F.col(end) == F.col(f"{b}__id")
            if len(labels[b]) > 1:
                same = same & (F.col(end_label) == F.col(f"{b}__label"))
            return State(w.filter(same).drop(end, end_label), out.vars)
        out = self.arrive(out, end, end_label, nodes[b], labels[b])
        return State(out.df.drop(end, end_label), out.vars)

    def nothing(self, st: State, r: Rel, b: str, nodes, labels, closing: bool) -> State:
        """No edge can be there: no rows, but all variables."""
        df, vars_ = st.df.filter(F.lit(False)), dict(st.vars)
        if not closing:
            rows, vars_[b] = self.vertex_rows(b, labels[b])
            df = df.crossJoin(rows.limit(0))
        if r.named:
            vars_[r.var] = Bound("edge")
        return State(df, vars_)

    def optional(self, st: State, c) -> State:
        """Built from the distinct bindings that the clause speaks of, joined back null-safely."""
        used = {n.var for p in c.paths for n in p.nodes} | names(c.where)
        used |= {x for p in c.paths for n in (*p.nodes, *p.rels) for _, e in n.props for x in names(e)}
        keys = [x for x in st.df.columns if any(x.startswith(f"{v}__") for v in used if v in st.vars)]
        outer = State(st.df.select(*keys).distinct() if keys else None, {v: b for v, b in st.vars.items() if v in used})
        self.later = None if self.later is None else self.later | used
        inner = self.match(outer, c.paths, c.where)
        new = {v: b for v, b in inner.vars.items() if v not in st.vars}
        return State(O.optional(st.df, O.spread(inner.df), keys), {**st.vars, **new})

    # projections

    def project(self, st: State, p: Project) -> State:
        items = list(p.items)
        if p.star:
            visible = [v for v, b in st.vars.items() if not v.startswith("_anon") and b.kind != "edge"]
            items = [Item(Var(v), v, True) for v in visible] + items
            if not items:
                raise SemanticProblem("nothing to return")
        checks.check_items(replace(p, items=tuple(items)))
        if st.df is None:
            st = State(self.g.spark.range(1).select(F.lit(1).alias("__seed")), {})
        aggregated = any(has_agg(i.expr) for i in items) or any(has_agg(e) for e, _ in p.order)
        if "__n" in st.df.columns:
            aggs = [x for e in [*(i.expr for i in items), *(e for e, _ in p.order)] for x in walk(e) if isinstance(x, Agg)]
            self.counted = aggregated and all(x.fn in ("count", "min", "max") or x.distinct for x in aggs)
            if not self.counted:
                st = State(st.df.drop("__n") if p.distinct and not aggregated else O.spread(st.df), st.vars)
        else:
            self.counted = False
        cols, vars_, where_is = [], {}, {}
        for i in items:
            for c in self.columns(i, st, p.final, vars_):
                cols.append(c)
            where_is[i.expr] = i.name
        plain_names = [n for n, _ in cols]
        order, hidden = [], []
        for e, up in p.order:
            if isinstance(e, Var) and e.name in [i.name for i in items]:
                src = self.sort_name(e.name, vars_, p.final)
            elif e in where_is:
                src = self.sort_name(where_is[e], vars_, p.final)
            else:
                if p.distinct or aggregated and not has_agg(e):
                    raise SemanticProblem("ORDER BY of something that isn't returned")
                src = self.name("o")
                hidden.append((src, self.expr(e, st)[0]))
            order.append(F.col(f"`{src}`").asc() if up else F.col(f"`{src}`").desc())
        if aggregated:
            keys = [(n, c) for n, c in cols if n not in self.agg_names(items, p.final)]
            aggs = [(n, c) for n, c in cols if n in self.agg_names(items, p.final)] + hidden
            pre = st.df
            kn = [self.name("k") for _ in keys]
            for k, (_, c) in zip(kn, keys):
                pre = pre.withColumn(k, c)
            df = pre.groupBy(*kn).agg(*[c.alias(n) for n, c in aggs])
            back = {n: k for k, (n, _) in zip(kn, keys)}
            df = df.select(*[F.col(f"`{back.get(n, n)}`").alias(n) for n, _ in cols], *[F.col(n) for n, _ in hidden])
        else:
            df = st.df.select(*[c.alias(n) for n, c in cols + hidden])
            if p.distinct:
                df = df.distinct()
        if order:
            df = df.orderBy(*order)
        if p.skip:
            df = df.offset(p.skip)
        if p.limit is not None:
            df = df.limit(p.limit)
        if hidden:
            df = df.select(*[F.col(f"`{n}`") for n in plain_names])
        out = State(df, vars_)
        if p.where is not None:
            checks.check_where(p.where)
            out = self.where(out, p.where)
        return out

    def agg_names(self, items, final: bool) -> set[str]:
        return {i.name if final else f"{i.name}__v" for i in items if has_agg(i.expr)}

    def sort_name(self, n: str, vars_, final: bool) -> str:
        if final:
            return n
        return f"{n}__id" if vars_[n].kind == "node" else f"{n}__v"

    def columns(self, i: Item, st: State, final: bool, vars_: dict):
        """(name, column) of an item: one in RETURN, all of a node's columns in WITH."""
        if isinstance(i.expr, Var) and i.expr.name in st.vars and not final:
            v, b = i.expr.name, st.vars[i.expr.name]
            if b.kind in ("node", "edge"):
                vars_[i.name] = b
                own = [x for x in st.df.columns if x in (f"{v}__id", f"{v}__label") or x.startswith(f"{v}__p_")]
                return [(i.name + x[len(v) :], F.col(x)) for x in own]
        c, kind = self.expr(i.expr, st)
        vars_[i.name] = Bound(kind)
        return [(i.name if final else f"{i.name}__v", c)]
