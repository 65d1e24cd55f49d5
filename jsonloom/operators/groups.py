"""Grouping, distinct values, extremes and order, with the rules for ties: the first of the least, the last of the greatest.

All of these aggregate before they shuffle; none sorts or collects a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jsonloom.operators.streams import kept


def group_by(df: DataFrame, keys: list[Column], **aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[x.alias(name) for name, x in aggregates.items()])


def group_numbers(df: DataFrame, key: str, row: str, **aggregates: Column) -> DataFrame:
    """By a number; NaN equals nothing, so each NaN is a group of its own, told apart by the row's id."""
    own = F.when(F.isnan(key), F.col(row)).alias("__own")
    return df.groupBy(key, own).agg(*[x.alias(name) for name, x in aggregates.items()]).drop("__own")


def unique(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def unique_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def min_by(df: DataFrame, by: list[str], value: str, order: list[str], out: Column, name: str = "value") -> DataFrame:
    """Of each group's least value the first row's output."""
    return df.groupBy(*by).agg(F.min_by(out, F.struct(value, *order)).alias(name))


def max_by(df: DataFrame, by: list[str], value: str, order: list[str], out: Column, name: str = "value") -> DataFrame:
    """Of each group's greatest value the last row's output."""
    return df.groupBy(*by).agg(F.max_by(out, F.struct(value, *order)).alias(name))


def any_all(df: DataFrame, by: list[str], condition: Column) -> DataFrame:
    held = F.coalesce(condition, F.lit(False))
    return df.groupBy(*by).agg(F.bool_or(held).alias("any"), F.bool_and(held).alias("all"))


def sort_by(df: DataFrame, *keys: Column | str, top: int | None = None) -> DataFrame:
    """In order; with `top` only so many rows, which needs no full sort."""
    ordered = df.orderBy(*keys)
    return ordered if top is None else ordered.limit(top)


def added(df: DataFrame, by: list[str], value: str, order: list[str], kind: str = "number", name: str = "added") -> DataFrame:
    """The sum of numbers, or strings put together in order; null for a group of nulls."""
    if kind == "number":
        return df.groupBy(*by).agg(F.sum(value).alias(name))
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__value"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["__value"]), "").alias(name))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def placed(df: DataFrame, *keys: str, name: str = "place") -> DataFrame:
    """Each row's place in the order of all, from 1, for keys that are distinct. Rows are dealt by ranges of the keys and numbered
    in their range, after the counts of the ranges before it; no task sorts all."""
    ranges = kept(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))  # once, as ranges are drawn by sample
    counts, before = [], 0
    for number, n in sorted(map(tuple, ranges.groupBy("__range").count().collect())):
        counts.append((number, before))
        before += n
    starts = F.broadcast(df.sparkSession.createDataFrame(counts, "__range int, __before long"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return ranges.withColumn(name, within).join(starts, "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")
