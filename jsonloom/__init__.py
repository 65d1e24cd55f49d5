"""Jsonloom: JSON filter operations as PySpark columns and DataFrames."""
