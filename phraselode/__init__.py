"""Phraselode: keyphrase extraction, rank fusion and spatial re-ranking on Spark DataFrames."""

__version__ = "0.1.0"
