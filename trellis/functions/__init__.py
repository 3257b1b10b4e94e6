"""Expressions and aggregates of the query language as Spark columns."""
