"""Spark-native analytics for conversation stores, usage ledgers and retrieval."""
