"""Spark-native operators for panels of daily return series."""
