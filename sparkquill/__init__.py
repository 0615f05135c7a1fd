"""Spark-native corpus and interaction analytics."""
