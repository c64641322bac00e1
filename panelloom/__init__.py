"""Spark-native analytics for actor-by-period panels."""
