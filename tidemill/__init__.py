"""Spark-native warehouse and analytics toolkit."""
