"""Truth, kinds, equality, the order over all kinds, and text of numbers.

JSON null and a missing field are both SQL NULL here, so comparisons are null-safe: null equals null and sorts first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks of the kinds in the order over all values.
KINDS = ["null", "false", "true", "number", "string", "array", "object"]


def truthy(x: Column, boolean: bool = False) -> Column:
    """Only null and false are false; `boolean` says that x is a boolean column."""
    return F.coalesce(x, F.lit(False)) if boolean else x.isNotNull()


def negated(x: Column, boolean: bool = False) -> Column:
    return ~truthy(x, boolean)


def alternative(*options: Column, booleans: bool = False) -> Column:
    """The first option that is neither null nor false, else the last."""
    if not booleans:
        return F.coalesce(*options)
    out = options[-1]
    for x in reversed(options[:-1]):
        out = F.when(truthy(x, True), x).otherwise(out)
    return out


def equal(x: Column, y: Column) -> Column:
    """Null equals null; NaN equals nothing, not even itself (give doubles)."""
    return x.eqNullSafe(y)


def equal_numbers(x: Column, y: Column) -> Column:
    return x.eqNullSafe(y) & ~F.coalesce(F.isnan(x.cast("double")), F.lit(False))


def number_key(x: Column) -> Column:
    """Sorts numbers with null first, then NaN, which is below every number."""
    return F.struct(x.isNotNull().alias("some"), (~F.coalesce(F.isnan(x.cast("double")), F.lit(False))).alias("real"), x.alias("value"))


def less(x: Column, y: Column) -> Column:
    """x < y for values of one kind or null; null is below all else."""
    return F.when(x.isNull(), y.isNotNull()).when(y.isNull(), F.lit(False)).otherwise(x < y)


def less_numbers(x: Column, y: Column) -> Column:
    """As less(), and NaN is below every number and below itself."""
    nan = F.coalesce(F.isnan(x.cast("double")), F.lit(False))
    return F.when(x.isNull(), y.isNotNull()).when(y.isNull(), F.lit(False)).when(nan, F.lit(True)).when(F.isnan(y.cast("double")), F.lit(False)).otherwise(x < y)


def mixed_key(number: Column | None = None, string: Column | None = None, boolean: Column | None = None) -> Column:
    """A sort key over columns of which at most one is not null in a row: null, false, true, numbers, strings."""
    number = F.lit(None).cast("double") if number is None else number.cast("double")
    string = F.lit(None).cast("string") if string is None else string
    boolean = F.lit(None).cast("boolean") if boolean is None else boolean
    rank = F.when(string.isNotNull(), 4).when(number.isNotNull(), 3).when(boolean, 2).when(boolean.isNotNull(), 1).otherwise(0)
    return F.struct(rank.alias("kind"), F.coalesce(~F.isnan(number), F.lit(True)).alias("real"), number.alias("number"), string.alias("string"))


def variant_kind(v: Column) -> Column:
    """The kind of a VARIANT value, false and true both being "boolean"."""
    schema = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (schema == "VOID"), "null").when(schema == "BOOLEAN", "boolean").when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array").when(schema.isin("STRING"), "string").otherwise("number")
    )


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def number_text(x: Column) -> Column:
    """A number as JSON text: the shortest digits, plain between 1e-5 and sixteen zeros, else with an exponent of two digits;
    NaN is null, infinities are the largest doubles. For integer columns a cast to string does the same."""
    return let(x.cast("double"), lambda v: F.when(v.isNull() | F.isnan(v), "null").when(v == F.floor(v).cast("double"), _whole_text(v)).otherwise(_text(v)))


def _whole_text(v: Column) -> Column:
    return F.when(F.abs(v) < 1e15, v.cast("bigint").cast("string")).otherwise(_text(v))


def _text(v: Column) -> Column:
    most = F.lit(1.7976931348623157e308)
    shown = F.abs(F.greatest(F.least(v, most), -most)).cast("string")
    return F.concat(F.when(v < 0, "-").otherwise(""), let(F.split(shown, "[.E]"), _digits))


def _digits(parts: Column) -> Column:
    """From Spark's whole part, fraction and exponent."""
    whole, part, exponent = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.coalesce(F.get(parts, F.lit(2)).cast("int"), F.lit(0))
    raw = F.concat(whole, F.when(part == "0", "").otherwise(part))
    return let(F.struct(raw.alias("raw"), (F.length(whole) + exponent).alias("point")), lambda r: let(F.struct(F.rtrim(F.ltrim(r["raw"], F.lit("0")), F.lit("0")).alias("digits"), (r["point"] - F.length(r["raw"]) + F.length(F.ltrim(r["raw"], F.lit("0")))).alias("point")), _placed))


def _placed(r: Column) -> Column:
    digits, point = r["digits"], r["point"]
    n, power = F.length(digits), F.abs(point - 1).cast("string")
    scientific = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.when(point > 0, "e+").otherwise("e-"), F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power))
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point < n, F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
        .otherwise(F.concat(digits, F.repeat(F.lit("0"), point - n)))
    )
    return F.when((point <= -4) | (point > n + 15), scientific).otherwise(plain)


def text_of(x: Column, kind: str) -> Column:
    """A value as text, strings as they are: kind is "number", "boolean", "string" or "json" (arrays and objects)."""
    shown = {"number": lambda: number_text(x), "boolean": lambda: x.cast("string"), "string": lambda: x, "json": lambda: F.to_json(x)}[kind]()
    return F.coalesce(shown, F.lit("null"))
