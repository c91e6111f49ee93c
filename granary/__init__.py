"""Spark-native platform observability, data quality and corpus preparation."""
