"""Spark-native engine for scholarly corpus extraction and text statistics."""

__version__ = "0.1.0"
