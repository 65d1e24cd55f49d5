"""Raising, catching and selecting by kind.

An error that a value can cause is caught by asking for null instead (Spark's try_ functions, strings.try_number(),
arith.try_divided()); attempt() puts the handler's value in its place.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.functions import maths


def error(message: Column | str, kind: str = "string") -> Column:
    """Ends the query with a message, wherever a row gets here."""
    return F.raise_error(message if isinstance(message, Column) else F.lit(message)).cast(kind)


def attempt(tried: Column, handler: Column, failed: Column) -> Column:
    """tried, or the handler's value where `failed` says that it would fail."""
    return F.when(F.coalesce(failed, F.lit(False)), handler).otherwise(tried)


def debug(df: DataFrame, to, *measures: Column) -> DataFrame:
    """The same rows; aggregates over them go to an Observation (or a name, for a listener) once they have been read."""
    return df.observe(to, *measures)


def finites(x: Column) -> Column:
    """x where it is neither an infinity nor NaN."""
    return F.when(maths.is_finite(x) & ~maths.is_nan(x), x)


def normals(x: Column) -> Column:
    """x where it is no zero, subnormal, infinity or NaN."""
    return F.when(maths.is_normal(x), x)


def environment(*names: str) -> Column:
    """The driver's environment variables of these names as a map, null where one is not set."""
    return F.create_map(*[x for n in names for x in (F.lit(n), F.lit(os.environ.get(n)).cast("string"))])


def only(x: Column, kind: Column, *kinds: str) -> Column:
    """x where its kind is one of these, else null: arrays, objects, iterables, booleans, numbers, strings, nulls, scalars."""
    return F.when(kind.isin(*kinds), x)


#: What the kind selectors keep.
SELECTORS = {
    "arrays": ("array",), "objects": ("object",), "iterables": ("array", "object"), "booleans": ("boolean",), "numbers": ("number",), "strings": ("string",), "nulls": ("null",),
    "values": ("boolean", "number", "string", "array", "object"), "scalars": ("null", "boolean", "number", "string"),
}
