"""Spark-native analytics operators for routine surveillance data."""
