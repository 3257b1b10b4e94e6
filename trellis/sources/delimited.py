"""Delimited text with a typed header line, `name:type|name:type|...`, the only file format of graphs.

A vertex file needs one `id` column, an edge file `start_id` and `end_id`; `label` or `type` names the vertex label or edge
type of a row. Other types: int, long, short, float, double, bool, boolean, string, char; without a type: string. An empty
cell is an absent property. Booleans are true for the text "true" in any case, else false.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from .graph import PropertyGraph

_KINDS = {"int": "bigint", "long": "bigint", "short": "bigint", "float": "double", "double": "double", "string": "string", "char": "string", "": "string", "bool": "bool", "boolean": "bool"}
_ROLES = {"id", "start_id", "end_id", "label", "type"}


def header(line: str, sep: str = "|") -> list[tuple[str, str]]:
    out = []
    for cell in line.rstrip("\r\n").split(sep):
        name, _, kind = cell.partition(":")
        kind = kind.strip().lower()
        if kind not in _KINDS and kind not in _ROLES:
            raise QueryError(f"unknown type {kind} of column {name}")
        out.append((name.strip(), kind))
    return out


def read(spark: SparkSession, path: str, sep: str = "|") -> tuple[DataFrame, list[tuple[str, str]]]:
    """One file with its header. Rows of another number of cells abort the read, as a column-count mismatch must."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise QueryError(f"{path} is empty")
    cols = header(first[0][0], sep)
    raw = spark.read.option("sep", sep).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
    df = raw.csv(path).toDF(*[f"c{k}" for k in range(len(cols))])
    out = []
    for k, (name, kind) in enumerate(cols):
        c = F.col(f"c{k}")
        if kind in ("id", "start_id", "end_id"):
            c = c.cast("bigint")
        elif _KINDS.get(kind) == "bool":
            c = F.lower(c) == "true"
        elif kind in _KINDS:
            c = c.cast(_KINDS[kind])
        out.append(c.alias({"start_id": "__src", "end_id": "__dst", "label": "__label", "type": "__label"}.get(kind, name)))
    return df.select(*out), cols


def load(spark: SparkSession, vertices: list[tuple[str | None, list[str]]], edges: list[tuple[str | None, list[str]]], ends: dict[str, tuple[str, str]], sep: str = "|") -> PropertyGraph:
    """vertices and edges: (label or type, files); None takes it from the rows' own column. ends: type -> labels of its ends.

    Files after the first of a group that can't be read are left out, as long as the first can.
    """
    g = PropertyGraph(spark)

    def group(files):
        df, cols = read(spark, files[0], sep)
        for f in files[1:]:
            if "://" in f or os.path.exists(f):
                df = df.unionByName(read(spark, f, sep)[0])
        return df, cols

    def split(name, files):
        df, cols = group(files)
        if "__label" not in df.columns:
            if name is None:
                raise QueryError(f"{files[0]}: no label")
            return [(name, df)], cols
        labels = [r[0] for r in df.select("__label").distinct().collect()]  # as many as labels
        if None in labels or name and labels not in ([name], []):
            raise QueryError(f"{files[0]}: rows without a label" if None in labels else f"{files[0]}: rows of other labels than {name}")
        labels = labels or [name or ""]
        return [(n, df.filter(F.col("__label") == n).drop("__label")) for n in labels], cols

    for name, files in vertices:
        parts, cols = split(name, files)
        ids = [n for n, k in cols if k == "id"]
        if len(ids) != 1:
            raise QueryError(f"{files[0]}: one id column needed")
        for n, df in parts:
            g.add_vertices(n, df, ids[0])
    for name, files in edges:
        parts, cols = split(name, files)
        if sum(k == "start_id" for _, k in cols) != 1 or sum(k == "end_id" for _, k in cols) != 1:
            raise QueryError(f"{files[0]}: start_id and end_id needed")
        for n, df in parts:
            g.add_edges(n, *ends[n], df, "__src", "__dst", tuple(c for c in df.columns if not c.startswith("__")))
    problems = g.validate()
    if problems:
        raise QueryError("; ".join(problems))
    return g


def dump(df: DataFrame, path: str, sep: str = "|") -> None:
    """Write a result as delimited text."""
    df.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)
