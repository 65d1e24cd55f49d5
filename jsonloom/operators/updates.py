"""Assignments to paths that are known: a projection each, which never moves a row.

A path is a list of field names, with "[]" for every element of an array. Update functions get the old value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _into(x: Column, path: list[str], f: Callable[[Column], Column], keep: Callable[[Column], Column] | None) -> Column:
    if not path:
        return f(x)
    head, rest = path[0], path[1:]
    if head == "[]":
        if keep and not rest:
            x = F.filter(x, lambda e: F.coalesce(keep(e), F.lit(False)))
        return F.transform(x, lambda e: _into(e, rest, f, keep))
    return x.withField(f"`{head}`", _into(x.getField(head), rest, f, keep))


def update(df: DataFrame, path: list[str], f: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """The value at a path through f; elements for which `keep` fails go."""
    return df.withColumn(path[0], _into(F.col(f"`{path[0]}`"), path[1:], f, keep))


def assign(df: DataFrame, path: list[str], value: Column) -> DataFrame:
    """The value at a path set; the new value is read from the row as it was."""
    return update(df, path, lambda _: value)


def plus_assign(df: DataFrame, path: list[str], value: Column) -> DataFrame:
    return update(df, path, lambda old: F.when(old.isNull(), value).otherwise(old + F.coalesce(value, F.lit(0))))


def arith_assign(df: DataFrame, path: list[str], f: Callable[[Column, Column], Column], value: Column) -> DataFrame:
    """The value at a path and another through f, as in -=, *=, /= and %=; the other is read from the row as it was."""
    return update(df, path, lambda old: f(old, value))


def default(df: DataFrame, path: list[str], value: Column) -> DataFrame:
    """The value where there is null."""
    return update(df, path, lambda old: F.coalesce(old, value))


def delete(df: DataFrame, *paths: list[str]) -> DataFrame:
    """Without these columns or fields."""
    for path in paths:
        df = df.drop(path[0]) if len(path) == 1 else df.withColumn(path[0], F.col(f"`{path[0]}`").dropFields(".".join(f"`{p}`" for p in path[1:])))
    return df


def pick(df: DataFrame, *paths: list[str]) -> DataFrame:
    """Only these columns or fields, nested as they were."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path:
            at = at.setdefault(part, {})

    def made(x: Column, below: dict) -> Column:
        return F.struct(*[made(x.getField(k), v).alias(k) for k, v in below.items()]) if below else x

    return df.select(*[made(F.col(f"`{k}`"), v).alias(k) for k, v in tree.items()])
