"""Tessera: Spark-native analytics over content-deduplicated object collections."""
