"""Spark-native analytics over two poles of example texts."""
