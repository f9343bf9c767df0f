"""Spark-native analytics for governed text corpora."""
