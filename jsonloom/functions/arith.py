"""The arithmetic operators, by the kinds of their operands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integers are cut to this range before a remainder is taken.
INT64 = (-9223372036854775808, 9223372036854775807)


def plus(x: Column, y: Column) -> Column:
    """Numbers, or strings or arrays by joined(); null is neutral."""
    return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x + y)


def joined(x: Column, y: Column) -> Column:
    """Strings or arrays one after the other; null is neutral."""
    return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.concat(x, y))


def merged(x: Column, y: Column) -> Column:
    """Maps: y's values win and keep the place of the key in x; null is neutral."""
    both = F.map_concat(F.map_filter(x, lambda k, _: ~F.coalesce(F.map_contains_key(y, k), F.lit(False))), y)
    order = F.concat(F.map_keys(x), F.filter(F.map_keys(y), lambda k: ~F.array_contains(F.map_keys(x), k)))
    return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.map_from_arrays(order, F.transform(order, lambda k: F.element_at(both, k))))


def without(x: Column, y: Column) -> Column:
    """Array x less every element that equals any of y; what stays keeps its repeats."""
    return F.filter(x, lambda a: ~F.exists(y, lambda b: a.eqNullSafe(b)))


def repeated(text: Column, times: Column) -> Column:
    """A string so many times, cut to an integer; null for a negative or NaN count, "" for under one."""
    times = times.cast("double")
    return F.when(F.isnan(times) | (times < 0), None).otherwise(F.repeat(text, F.floor(times).cast("int")))


def divided(x: Column, y: Column) -> Column:
    """Raises on a zero divisor."""
    return F.when(y == 0, F.raise_error(F.lit("cannot be divided because the divisor is zero")).cast("double")).otherwise(x.cast("double") / y)


def try_divided(x: Column, y: Column) -> Column:
    """Null on a zero divisor: division whose error is caught."""
    return F.try_divide(x.cast("double"), y.cast("double"))


def remainder(x: Column, y: Column) -> Column:
    """Both cut to integers; the dividend's sign; NaN for NaN; raises on a divisor under one in size."""
    nan = F.isnan(x.cast("double")) | F.isnan(y.cast("double"))
    cut = lambda v: F.when(v.cast("double") >= float(INT64[1]), F.lit(INT64[1])).when(v.cast("double") <= float(INT64[0]), F.lit(INT64[0])).otherwise(F.when(nan, F.lit(0)).otherwise(v).cast("bigint"))
    a, b = cut(x), cut(y)
    size = F.when(b == INT64[0], F.lit(INT64[1])).otherwise(F.abs(F.when(b == INT64[0], F.lit(1)).otherwise(b)))
    value = F.when(size == 1, F.lit(0)).otherwise(a % F.when(size == 0, F.lit(1)).otherwise(size))
    zero = F.raise_error(F.lit("cannot be divided (remainder) because the divisor is zero")).cast("double")
    return F.when(nan, F.lit(float("nan"))).when(b == 0, zero).otherwise(value.cast("double"))
