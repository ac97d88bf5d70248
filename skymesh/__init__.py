"""Gridded environmental analytics on Spark DataFrames."""
