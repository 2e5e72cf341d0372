"""Spark-native retrieval, governance and usage analytics."""
