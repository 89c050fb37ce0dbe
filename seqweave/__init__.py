"""Sequence-matching analytics on Spark DataFrames."""
