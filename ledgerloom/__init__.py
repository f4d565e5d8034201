"""Spark-native analytics for append-only evidence ledgers, and training-data operators."""
