"""Spark-native ranked text search and faceting over DataFrames."""
