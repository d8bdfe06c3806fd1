"""Spark-native document retrieval, extraction and evaluation engine."""
