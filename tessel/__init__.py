"""Spark-native text and vector retrieval with the analytics around it."""
