"""Lodestone: path, metadata and content queries over Spark DataFrames."""
