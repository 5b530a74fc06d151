"""Spark-native analytics for located labels, point clouds and embeddings."""

__version__ = "0.1.0"
