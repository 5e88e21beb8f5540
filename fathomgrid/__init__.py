"""Retrieval, graph and text-data processing over Spark DataFrames."""
