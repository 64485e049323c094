"""Spark-native engine for corpus preparation, retrieval and evaluation analytics."""

__version__ = "0.1.0"
