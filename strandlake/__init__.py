"""Spark-native catalogue and analytics for sequence collections."""
