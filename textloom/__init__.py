"""Spark-first text search and corpus analytics engine."""
