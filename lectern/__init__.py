"""Spark-native retrieval and corpus engine."""
