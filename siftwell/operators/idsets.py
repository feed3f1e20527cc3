"""Algebra of document sets: tables of ids. Each is one join or one aggregate by id, never a list on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def of(docs: DataFrame, key: str = "id") -> DataFrame:
    """The set of a table's ids; nulls are no members."""
    return docs.select(key).filter(f"`{key}` is not null").distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_semi")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_anti")


def complement(a: DataFrame, everything: DataFrame) -> DataFrame:
    return subtract(everything, a)


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of one of the sets but not of both."""
    return subtract(a, b).union(subtract(b, a))
