"""Spark-native culling and ranking of large photo shoots."""
