"""Scalar and array operations as Spark columns, one module for each kind of value."""
