"""Layered-memory retrieval, entity linking and graph search on Spark DataFrames."""

__version__ = "0.1.0"
