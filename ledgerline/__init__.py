"""Spark-native customer analytics: every job is a lazy DataFrame plan over Parquet tables."""
