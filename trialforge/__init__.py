"""Spark-native analytics over algorithm-benchmark results, plus training-data operators."""
