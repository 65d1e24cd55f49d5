"""String operations; positions and lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space for the trims.
SPACE = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def ascii_downcase(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def ascii_upcase(s: Column) -> Column:
    return F.translate(s, LOWER, UPPER)


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, r"\A" + SPACE, "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, SPACE + r"\z", "")


def trim(s: Column) -> Column:
    return rtrim(ltrim(s))


def ltrimstr(s: Column, left: str) -> Column:
    return F.when(s.startswith(left), F.substr(s, F.lit(len(left) + 1))).otherwise(s)


def rtrimstr(s: Column, right: str) -> Column:
    return F.when(s.endswith(right), F.substr(s, F.lit(1), F.length(s) - len(right))).otherwise(s)


def trimstr(s: Column, ends: str) -> Column:
    return rtrimstr(ltrimstr(s, ends), ends)


def split(s: Column, separator: str) -> Column:
    """By a literal separator; "" has no parts, and an empty separator gives the characters."""
    parts = explode(s, text=True) if separator == "" else F.split(s, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(parts)


def explode(s: Column, text: bool = False) -> Column:
    """The code points of a string, or its characters."""
    characters = F.when(s == "", F.array().cast("array<string>")).otherwise(F.filter(F.split(s, ""), lambda c: c != ""))
    return characters if text else F.transform(characters, lambda c: F.ascii(c))


def implode(points: Column) -> Column:
    """A string of code points; fractions are cut off. (Spark's chr() ends at 255.)"""
    return pandas_udf(lambda s: s.map(lambda x: None if x is None else "".join(chr(int(c)) for c in x)), "string")(points)


def join(values: Column, separator: str, kind: str = "string") -> Column:
    """Elements as text, null as ""; no elements give ""."""
    from jsonloom.functions.values import number_text

    shown = {"string": lambda x: x, "number": number_text, "boolean": lambda x: x.cast("string")}[kind]
    return F.array_join(F.transform(values, lambda x: F.when(x.isNull(), "").otherwise(shown(x))), separator)


def slice(s: Column, start: Column | int | None = None, end: Column | int | None = None) -> Column:
    """s[start:end], negative positions from the end; a fraction at the end counts, one at the start does not."""
    n = F.length(s)
    place = lambda v, default, up: default if v is None else F.greatest(F.lit(0), F.least(n, (lambda p: F.when(p < 0, p + n).otherwise(p))((F.ceil if up else F.floor)(v if isinstance(v, Column) else F.lit(v)).cast("int"))))
    low, high = place(start, F.lit(0), False), place(end, n, True)
    return F.substr(s, low + 1, F.greatest(high - low, F.lit(0)))


def indices(s: Column, needle: str) -> Column:
    """Where a string occurs, overlaps included; none for an empty needle."""
    if needle == "":
        return F.array().cast("array<int>")
    places = F.when(F.length(s) < len(needle), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.length(s) - len(needle), F.lit(0))))
    return F.filter(places, lambda i: F.substr(s, i + 1, F.lit(len(needle))) == needle)


def index(s: Column, needle: str) -> Column:
    """The first occurrence, or null."""
    return F.nullif(F.instr(s, needle), F.lit(0)) - 1 if needle else F.lit(None).cast("int")


def rindex(s: Column, needle: str) -> Column:
    """The last occurrence, or null."""
    if needle == "":
        return F.lit(None).cast("int")
    behind = F.instr(F.reverse(s), needle[::-1])
    return F.when(behind > 0, F.length(s) - behind - len(needle) + 1)


def contains(s: Column, part: Column) -> Column:
    return F.contains(s, part)


def byte_length(s: Column) -> Column:
    return F.octet_length(s)


def to_number(s: Column) -> Column:
    """A JSON-like number, strictly: no white space, suffix or sign in front but a minus; raises otherwise."""
    valid = s.rlike(r"\A-?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z") | s.isin("nan", "NaN")
    return F.when(valid, s.try_cast("double")).when(s.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("cannot be parsed as a number: "), s)).cast("double"))


def try_number(s: Column) -> Column:
    """As to_number(), with null for what is no number."""
    return F.when(s.rlike(r"\A-?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z"), s.try_cast("double"))


def to_boolean(s: Column) -> Column:
    return F.when(s == "true", True).when(s == "false", False).when(s.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("cannot be parsed as a boolean: "), s)).cast("boolean"))
