"""Streams: a DataFrame is a stream of values, and the order of its values is in columns.

A generator that makes several outputs of a row adds an ordinal column, so that a later operation can keep the order; nothing
is sorted or numbered before an operation needs it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jsonloom.functions import arrays
from jsonloom.functions.arrays import places
from jsonloom.functions.values import let


def each(df: DataFrame, column: str, value: str = "value", ordinal: str | None = "at", keep: list[str] | None = None) -> DataFrame:
    """A row for each element of an array or value of a map; an empty one or null has no rows. Maps add the column `key`."""
    rest = [c for c in (keep if keep is not None else df.columns) if c != column]
    names = ["key", value] if df.schema[column].dataType.typeName() == "map" else [value]
    made = df.select(*rest, F.posexplode(column).alias(ordinal or "__at", *names))
    return made if ordinal else made.drop("__at")


def comma(df: DataFrame, outputs: list[Column], value: str = "value", ordinal: str = "at") -> DataFrame:
    """A row for each of several outputs of each row, in their order; one pass over the input."""
    return df.select(*df.columns, F.posexplode(F.array(*outputs)).alias(ordinal, value))


def union_all(*frames: DataFrame, ordinal: str = "part") -> DataFrame:
    """All rows of one frame after those of another."""
    return fold(DataFrame.unionByName, [f.withColumn(ordinal, F.lit(i)) for i, f in enumerate(frames)])


def select(df: DataFrame, condition: Column) -> DataFrame:
    """The rows for which the condition is neither false nor null."""
    return df.where(condition)


def ranges(df: DataFrame, count: Column, value: str = "value") -> DataFrame:
    """A row for each of 0, 1, ... below a count."""
    return df.select(*df.columns, F.explode(places(F.ceil(count))).alias(value))


def product(*frames: DataFrame) -> DataFrame:
    """Every row of one frame with every row of the next: only for frames that are small by their meaning."""
    return fold(lambda a, b: a.crossJoin(b), frames)


def collected(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "values") -> DataFrame:
    """An array of the values of each group, in order. A group must fit in one row."""
    gathered = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__value"))))
    return df.groupBy(*by).agg(F.transform(gathered, lambda x: x["__value"]).alias(name))


def _numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def limit(df: DataFrame, n: float, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The first n outputs, of all or of each group; a fraction counts as one more."""
    if n < 0:
        raise ValueError("limit doesn't support negative count")
    n = int(-(-n // 1))
    if not by:
        return df.orderBy(*order).limit(n)
    return _numbered(df, by, order).where(F.col("__n") <= n).drop("__n")


def skip(df: DataFrame, n: float, order: list[str], by: list[str] | None = None) -> DataFrame:
    """All outputs but the first n; a fraction is cut off."""
    if n < 0:
        raise ValueError("skip doesn't support negative count")
    if not by:
        return df.orderBy(*order).offset(int(n))
    return _numbered(df, by, order).where(F.col("__n") > int(n)).drop("__n")


def nth(df: DataFrame, n: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Output n, from 0."""
    if n < 0:
        raise ValueError("nth doesn't support negative indices")
    if not by:
        return df.orderBy(*order).offset(n).limit(1)
    return _numbered(df, by, order).where(F.col("__n") == n + 1).drop("__n")


def first(df: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """The first row of each group, without sorting the groups."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*by, "__row.*")


def last(df: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*by, "__row.*")


def is_empty(df: DataFrame) -> DataFrame:
    """One row that says whether there are none; reads until the first."""
    return df.limit(1).agg((F.count(F.lit(1)) == 0).alias("empty"))


def alternative(outputs: DataFrame, others: DataFrame, key: list[str], value: str) -> DataFrame:
    """For each key the outputs that are neither null nor false; for keys without any, the other's rows."""
    good = outputs.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "false" if dict(outputs.dtypes)[value] == "boolean" else F.lit(True)))
    return good.unionByName(others.join(good.select(*key).distinct(), key, "left_anti"))


def reduce(df: DataFrame, by: list[str], **states: Column) -> DataFrame:
    """Folds whose order doesn't matter, as aggregates: sum, count, min, max and what is built on them."""
    return df.groupBy(*by).agg(*[x.alias(name) for name, x in states.items()])


def foreach(df: DataFrame, order: list[str], by: list[str], **states: Column) -> DataFrame:
    """The state after each row: aggregates over the rows so far, in order, in each group."""
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(*df.columns, *[x.over(so_far).alias(name) for name, x in states.items()])


#: How many levels recurse() makes of a row at once.
LEVELS = 16


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once: in spark.checkpoint.dir, or cached where there is none."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def recurse(df: DataFrame, value: str, step: Callable[[Column], Column], depth: int | None = None, while_: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each value, then what step makes of it, and so on until null or the condition fails; the level is in the column
    `level`. Some levels at once are expressions of the row, and rows that go on after them are the input of the next ones, so
    it never ends where a value goes on forever. With `depth`, the levels after it are left out, and the input is read once."""
    kind, rest = dict(df.dtypes)[value], [c for c in df.columns if c != value]
    alive = lambda v: v.isNotNull() if while_ is None else F.coalesce(while_(v), F.lit(False))
    following = lambda s: F.when(s.isNotNull(), let(step(s), lambda v: F.when(alive(v), v)))
    states = lambda n: arrays.running(arrays.places(F.lit(n + 1)), F.lit(None), lambda s, i: F.when(i == 0, F.col(value)).otherwise(following(s)), kind)
    if depth is not None:
        return df.select(*rest, F.posexplode(F.filter(states(depth), lambda v, i: (i == 0) | v.isNotNull())).alias("level", value))
    found, start = [], 0
    while True:
        made = kept(df.select(*rest, states(LEVELS).alias("__states")))
        # the first state of a later round is the last of the one before
        levels = made.select(*rest, F.posexplode(F.filter("__states", lambda v, i: (i == 0) | v.isNotNull())).alias("level", value))
        found.append(levels.where(F.col("level") >= (1 if start else 0)).withColumn("level", F.col("level") + start))
        df = made.select(*rest, F.element_at("__states", LEVELS + 1).alias(value)).where(F.col(value).isNotNull())
        if df.isEmpty():
            return fold(DataFrame.unionByName, found)
        start += LEVELS


def while_(df: DataFrame, value: str, condition: Callable[[Column], Column], step: Callable[[Column], Column]) -> DataFrame:
    """Each value, then what step makes of it, as long as the condition holds, the first included; with the column `level`."""
    return recurse(df.where(condition(F.col(value))), value, step, while_=condition)


def until(df: DataFrame, value: str, condition: Callable[[Column], Column], step: Callable[[Column], Column]) -> DataFrame:
    """What step makes of each value, again and again, once the condition holds; no row where a step gives null before."""
    held = lambda v: F.coalesce(condition(v), F.lit(False))
    return recurse(df, value, lambda v: F.when(~held(v), step(v))).where(held(F.col(value))).drop("level")
