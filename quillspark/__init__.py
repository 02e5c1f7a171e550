"""Spark-first text profiling, ranking and evaluation engine."""

__version__ = "0.1.0"
