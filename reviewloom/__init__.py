"""Spark-native analytics over code-change review data."""
