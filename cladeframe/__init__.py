"""Sequence placement, alignment algebra and tree comparison on Spark DataFrames."""
