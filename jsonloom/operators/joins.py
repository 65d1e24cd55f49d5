"""Lookups, membership and nested generators as joins; Spark picks how each runs from the sizes that it measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def index(df: DataFrame, key: Column, order: list[str], name: str = "key", row: str = "row") -> DataFrame:
    """The last row of each key, as a struct."""
    return df.groupBy(key.alias(name)).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias(row))


def join(df: DataFrame, indexed: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Each row with what the index has for its key, null where it has none."""
    return df.join(indexed, key == indexed[name], "left").drop(indexed[name])


def is_in(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the other stream; null is in a stream that has null."""
    return df.join(others.select(F.col(key).alias("__key")).distinct(), F.col(key).eqNullSafe(F.col("__key")), "left_semi")


def not_in(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return df.join(others.select(F.col(key).alias("__key")).distinct(), F.col(key).eqNullSafe(F.col("__key")), "left_anti")


def flagged(df: DataFrame, others: DataFrame, key: str, name: str = "found") -> DataFrame:
    """Every row, and whether its key is in the other stream."""
    known = others.select(F.col(key).alias("__key")).distinct().withColumn("__found", F.lit(True))
    return df.join(known, F.col(key).eqNullSafe(F.col("__key")), "left").withColumn(name, F.coalesce("__found", F.lit(False))).drop("__key", "__found")


def nested(df: DataFrame, other: DataFrame, condition: Column) -> DataFrame:
    """Pairs of two generators for which a condition holds; give equalities in it where there are any."""
    return df.join(other, condition)


def minus(df: DataFrame, others: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that equal no row of the other stream; what stays keeps its repeats."""
    keys = others.select(*[F.col(c).alias(f"__{c}") for c in columns]).distinct()
    condition = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]
    return df.join(keys, condition, "left_anti")
