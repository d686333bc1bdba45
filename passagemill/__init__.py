"""Corpus preparation, retrieval and retrieval-quality evaluation on Spark DataFrames."""

__version__ = "0.1.0"
