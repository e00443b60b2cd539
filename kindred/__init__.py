"""Kindred: identity resolution over embeddings, on DataFrames, Spark SQL and Structured Streaming."""

__version__ = "0.1.0"
