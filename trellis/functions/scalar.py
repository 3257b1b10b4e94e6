"""Typed scalar rules: which Spark column an operator on values of two kinds becomes.

Kinds are int, float, string, bool, node and null. Mixed kinds are settled here, before Spark sees them, as its ANSI mode
would raise: an equality of different kinds is false, an order comparison of them is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SemanticProblem

Typed = tuple[Column, str]
NUMBER = {"int", "float"}
EPSILON = 1e-10


def null(kind: str = "null") -> Typed:
    return F.lit(None).cast({"int": "bigint", "float": "double", "bool": "boolean"}.get(kind, "string")), kind


def _never(a: Column, b: Column) -> Column:
    """False where both are there, else null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.lit(False))


def as_bool(x: Typed) -> Column:
    c, k = x
    if k == "bool":
        return c
    return c != 0 if k == "int" else F.lit(None).cast("boolean")


def compare(op: str, x: Typed, y: Typed) -> Typed:
    (a, ka), (b, kb) = x, y
    if "null" in (ka, kb):
        return null("bool")
    if op in ("=", "<>"):
        if ka == kb == "float":
            eq = F.abs(a - b) < EPSILON
        elif ka == kb or {ka, kb} == NUMBER:
            eq = a == b
        else:
            eq = _never(a, b)
        return (eq if op == "=" else ~eq), "bool"
    if ka != kb and {ka, kb} != NUMBER or ka == "node":
        return null("bool")
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], "bool"


def arithmetic(op: str, x: Typed, y: Typed) -> Typed:
    (a, ka), (b, kb) = x, y
    if op == "+" and ka == kb == "string":
        return F.concat(a, b), "string"
    if ka not in NUMBER or kb not in NUMBER:
        return null()
    whole = ka == kb == "int"
    if op == "/":
        safe = F.nullif(b, F.lit(0))
        return (F.call_function("div", a, safe), "int") if whole else (a / safe, "float")
    if op == "%":
        return (a % F.nullif(b, F.lit(0)), "int") if whole else null("int")
    return {"+": a + b, "-": a - b, "*": a * b}[op], "int" if whole else "float"


def unary(op: str, x: Typed) -> Typed:
    c, k = x
    if op == "not":
        return ~as_bool(x), "bool"
    if op == "isnull":
        return c.isNull(), "bool"
    if op == "notnull":
        return c.isNotNull(), "bool"
    if k not in NUMBER:
        return null()
    return (-c if op == "-" else c), k


def literal(v) -> Typed:
    if v is None:
        return null()
    if isinstance(v, bool):
        return F.lit(v), "bool"
    if isinstance(v, int):
        return F.lit(v).cast("bigint"), "int"
    if isinstance(v, float):
        return F.lit(v), "float"
    return F.lit(str(v)), "string"


def aggregate(fn: str, x: Typed | None, distinct: bool) -> Typed:
    if x is None:
        return F.count(F.lit(1)), "int"
    c, k = x
    if fn == "count":
        return (F.count_distinct(c) if distinct else F.count(c)), "int"
    if fn in ("min", "max"):
        return getattr(F, fn)(c), k
    if k in ("string", "bool"):
        raise SemanticProblem(f"{fn} of {k} values")
    if k not in NUMBER:
        return null(k)
    if fn == "sum":
        return (F.sum_distinct(c) if distinct else F.sum(c)), k
    return (F.sum_distinct(c.cast("double")) / F.nullif(F.count_distinct(c), F.lit(0)) if distinct else F.avg(c)), "float"
