"""Expand, expand-into, variable length, semi, anti and existence tests, optional match.

Every input column has a name of its own (variable__part), so joins are on conditions over distinct names. Which join
runs how is Catalyst's to choose: small sides are broadcast by their size, others meet in a shuffle on the vertex id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..sources.graph import Edges
from ..sources.shared import written

FEW = 100_000  # rows that may be sent to all tasks
BLOCK = 10_000  # of the list that spreads a row


def edge_rows(defs: list[Edges], way: str, src_labels: set[str], dst_labels: set[str], props: tuple[str, ...], name: str, with_type: bool = False) -> DataFrame | None:
    """The edges from a source to a destination label as name__s, name__sl, name__d, name__dl and name__p_<property>.

    way both: in-neighbours after out-neighbours, so a self-loop counts twice. None when no definition fits.
    """
    parts = []
    for e in defs:
        for flip in ((False,), (True,), (False, True))[("out", "in", "both").index(way)]:
            a, b = (e.dst_label, e.src_label) if flip else (e.src_label, e.dst_label)
            if a not in src_labels or b not in dst_labels:
                continue
            s, d = ("__dst", "__src") if flip else ("__src", "__dst")
            own = [(F.col(p) if p in e.df.columns else F.lit(None)).alias(f"{name}__p_{p}") for p in props]
            kind = [F.lit(e.type).alias(f"{name}__type")] if with_type else []
            parts.append((e.back if flip else e.df).select(F.col(s).alias(f"{name}__s"), F.lit(a).alias(f"{name}__sl"), F.col(d).alias(f"{name}__d"), F.lit(b).alias(f"{name}__dl"), *own, *kind))
    return reduce(DataFrame.unionAll, parts) if parts else None


def expand(df: DataFrame, edges: DataFrame, src: list[tuple[str, str]]) -> DataFrame:
    """Inner join of the rows with their edges; src pairs a column of df with one of edges."""
    return df.join(edges, reduce(lambda a, b: a & b, [F.col(x) == F.col(y) for x, y in src]))


def exists(df: DataFrame, keys: DataFrame, on: list[tuple[str, str]], how: str) -> DataFrame:
    """left_semi or left_anti on key columns. Null keys match nothing."""
    return df.join(keys, reduce(lambda a, b: a & b, [F.col(x) == F.col(y) for x, y in on]), how)


def mark(df: DataFrame, keys: DataFrame, on: list[tuple[str, str]], name: str) -> DataFrame:
    """A boolean column that tells whether the row's keys are among keys: the existence join under OR."""
    k = keys.distinct().withColumn(name, F.lit(True))
    j = df.join(k, reduce(lambda a, b: a & b, [F.col(x) == F.col(y) for x, y in on]), "left")
    return j.drop(*[y for _, y in on]).withColumn(name, F.coalesce(name, F.lit(False)))


def optional(df: DataFrame, inner: DataFrame, keys: list[str]) -> DataFrame:
    """Left outer apply: inner was built from the distinct values of keys; null-safe, so null bindings meet again."""
    renamed = inner.select(*[F.col(c).alias(f"__k_{c}" if c in keys else c) for c in inner.columns])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys]) if keys else F.lit(True)
    return df.join(renamed, on, "left").drop(*[f"__k_{c}" for c in keys])


def few(df: DataFrame) -> tuple[DataFrame, bool]:
    """The rows, written to the shared folder, and whether they are few enough to be sent to all that read edges."""
    rows = written(df, "walks")
    return rows, rows.count() <= FEW


def gathered(df: DataFrame) -> DataFrame:
    """Equal rows as one, with how many they are in __n."""
    n = F.col("__n") if "__n" in df.columns else F.lit(1).cast("long")
    return df.withColumn("__n", n).groupBy(*[c for c in df.columns if c != "__n"]).agg(F.sum("__n").alias("__n"))


def spread(df: DataFrame) -> DataFrame:
    """Each row as often as __n tells. In two steps, so no list is longer than a row's number of walks needs."""
    if "__n" not in df.columns:
        return df
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {BLOCK}")))
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(BLOCK).cast("long"), F.expr(f"__n - __block * {BLOCK}"))))
    return df.withColumn("__block", block).withColumn("__one", one).drop("__n", "__block", "__one")


def walks(df: DataFrame, start: str, start_label: str | None, edges, low: int, high: int, end: str, end_label: str, labels: set[str], dead: tuple[str, ...] = (), large: bool = False, picked: bool = False) -> DataFrame:
    """One row per walk of low..high edges from start, with the end's id and label. edges(k) gives fresh edge rows of step k.

    Bounded lengths are unrolled joins; the frontier is all that is added to the rows. dead: columns, those of the start
    among them, that nothing asks for. Walks that differ only in these are gathered after each step and counted in __n, so
    a frontier has at most rows times vertices. Where edges are large, frontiers that are gathered or grow from picked
    vertices are written: a step then starts from rows, not from all steps before, and few rows are sent to the edges.
    """
    here = df.withColumn("__f", F.col(start)).withColumn("__fl", F.col(start_label) if start_label else F.lit(None).cast("string"))
    if dead:
        here = gathered(here.drop(*dead))
    out, keep = [], large and (picked or bool(dead))
    if low == 0:
        out.append(here)
    for k in range(1, high + 1):
        e = edges(k)
        if e is None:
            break
        s, sl, d, dl = (f"__w{k}__{x}" for x in ("s", "sl", "d", "dl"))
        on = F.col("__f") == F.col(s)
        if len(labels) > 1:
            on = on & (F.col("__fl") == F.col(sl))
        if keep:
            here, small = few(here)
            if k > low:
                out[-1] = here
            keep = small or bool(dead)
            here = F.broadcast(here) if small else here
        here = here.join(e, on).drop("__f", "__fl", s, sl).withColumnRenamed(d, "__f").withColumnRenamed(dl, "__fl")
        if dead:
            here = gathered(here)
        if k >= max(low, 1):
            out.append(here)
    if not out:
        return here.limit(0).withColumnRenamed("__f", end).withColumnRenamed("__fl", end_label)
    u = reduce(lambda a, b: a.unionByName(b), out)
    return u.withColumnRenamed("__f", end).withColumnRenamed("__fl", end_label)


def open_walks(df: DataFrame, start: str, start_label: str, edges: DataFrame | None, low: int, most: int, end: str, end_label: str, dead: tuple[str, ...] = ()) -> DataFrame:
    """Walks without an upper bound: one row per walk of low edges or more, equal ones counted in __n. edges are rows named __w.

    The driver writes each frontier to the shared folder until it is empty. A frontier holds how many walks lead from a
    row to a vertex, so it has at most rows times vertices. Walks of more than `most` edges are an error.
    """
    here = gathered(df.withColumn("__f", F.col(start)).withColumn("__fl", F.col(start_label).cast("string")).drop(*dead))
    out = [here] if low == 0 else []
    if edges is None:
        return (out[0] if out else here.limit(0)).withColumnRenamed("__f", end).withColumnRenamed("__fl", end_label)
    edges, k = written(edges, "walk-edges"), 0
    while True:
        on = (F.col("__f") == F.col("__w__s")) & (F.col("__fl") == F.col("__w__sl"))
        here = here.join(edges, on).drop("__f", "__fl", "__w__s", "__w__sl").withColumnRenamed("__w__d", "__f").withColumnRenamed("__w__dl", "__fl")
        here = written(gathered(here), "walks")
        if here.isEmpty():
            break
        k += 1
        if k > most:
            raise QueryError(f"a walk without an upper bound has more than {most} edges")
        if k >= low:
            out.append(here)
    u = reduce(lambda a, b: a.unionByName(b), out) if out else here
    return u.withColumnRenamed("__f", end).withColumnRenamed("__fl", end_label)
