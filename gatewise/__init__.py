"""Cytometry analytics on Spark DataFrames."""
