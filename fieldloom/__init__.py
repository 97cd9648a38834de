"""Spark-first analytics over frame observations, tracked paths and pairwise matches."""

__version__ = "0.1.0"
