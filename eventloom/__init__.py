"""Spark-native event listing analytics."""
