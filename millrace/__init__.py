"""Spark-native retrieval, ranking and evaluation analytics."""
