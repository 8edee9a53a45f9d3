"""Spark-native evidence retrieval, claim verification and dataset building."""
