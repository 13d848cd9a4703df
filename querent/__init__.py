"""Semantic query engine for Spark: see README.md."""
