"""Spark-first network threat analytics."""
