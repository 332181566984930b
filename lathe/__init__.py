"""Delay analytics on Spark: DataFrame operators that take column roles, not table names."""

__version__ = "0.1.0"
