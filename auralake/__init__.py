"""Spark-native analytics over object-based audio scenes and event tables."""
