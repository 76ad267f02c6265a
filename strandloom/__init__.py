"""Approximate-sequence analytics on Spark DataFrames."""
