"""Spark-native evidence analytics: findings, correlation and comparison over document corpora."""
