"""Outputs: compact JSON lines, raw strings, NUL-separated strings and record sequences, as text files by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_line(df: DataFrame) -> DataFrame:
    """Each row as a compact JSON object, null fields kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_line(df).write.mode(mode).text(path)


def write_raw(df: DataFrame, value: Column, path: str, separator: str = "\n", mode: str = "errorifexists") -> None:
    """Strings as they are; the separator may be \\n or NUL. A string that holds NUL can't be told apart then, and raises."""
    if separator == "\0":
        value = F.when(F.contains(value, F.lit("\0")), F.raise_error(F.lit("Cannot dump a string containing NUL with --raw-output0 option"))).otherwise(value)
    df.select(value.cast("string").alias("value")).write.mode(mode).option("lineSep", separator).text(path)


def write_sequence(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A record separator before each value."""
    json_line(df).select(F.concat(F.lit("\x1e"), "value").alias("value")).write.mode(mode).text(path)


def sorted_keys(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))
