"""Queries as Spark columns."""
