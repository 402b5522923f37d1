"""Spark-native image retrieval and place recognition."""
