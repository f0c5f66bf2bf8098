"""Deterministic source-text analysis on Spark DataFrames."""
