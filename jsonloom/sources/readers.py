"""Inputs: JSON lines with a known schema, any JSON values, raw lines, whole texts, record sequences and event streams.

Lines and sequences are split by Spark, so files are read in parallel; only whole texts are a row a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.functions import dynamic


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A value a line, typed; without a schema Spark reads the input once more to find one."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    """A value a line as JSON text, for data of no one shape."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("json"))


def json_values(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, json): values one after the other in each file, over any number of lines."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return dynamic.values_of(whole)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def raw_text(spark: SparkSession, path: str) -> DataFrame:
    """A row a file."""
    return spark.read.text(path, wholetext=True)


def sequence(spark: SparkSession, path: str) -> DataFrame:
    """Values behind record separators (RFC 7464) as JSON text; what doesn't parse is left out."""
    rows = spark.read.text(path, lineSep="\x1e").select(F.trim(F.regexp_replace("value", r"[\r\n]+\z", "")).alias("json"))
    return rows.where((F.col("json") != "") & F.try_parse_json("json").isNotNull())


def events(texts: DataFrame, column: str = "json") -> DataFrame:
    """(at, event) for each value: [path, leaf], and [path] at the end of each array or object."""
    return texts.select(F.posexplode(dynamic.tostream(F.col(column))).alias("at", "event"))


def slurped(df: DataFrame, column: str = "json") -> DataFrame:
    """All values as one JSON array in one row: only for inputs that fit in a row; aggregate the rows themselves otherwise."""
    return df.agg(F.concat(F.lit("["), F.array_join(F.collect_list(column), ","), F.lit("]")).alias(column))


def null_input(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(None).cast("string").alias("json"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): lines with their file and number from 1. A file must fit in one row."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.regexp_replace("value", r"\n\z", ""), "\n").alias("lines"))
    return whole.select("path", F.posexplode("lines").alias("at", "value")).select("path", (F.col("at") + 1).alias("line"), "value")
