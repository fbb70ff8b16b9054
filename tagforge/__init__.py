"""Spark-native analytics for hierarchical entity-annotation corpora."""
