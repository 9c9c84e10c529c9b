"""Spark-native hybrid retrieval, chunking and corpus processing."""
