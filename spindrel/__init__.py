"""Spark-native multi-vector retrieval and record processing."""

__version__ = "0.1.0"
