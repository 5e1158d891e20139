"""Spark-native retrieval analytics over structured documents."""

__version__ = "0.1.0"
