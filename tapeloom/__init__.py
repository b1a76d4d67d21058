"""Spark-native analytics over time-ordered market data."""
