"""Spark-native analytics over collections of annotated ancient texts."""
