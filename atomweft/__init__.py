"""Spark-native molecular analytics on long-form atom tables."""
