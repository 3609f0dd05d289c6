"""Spatial interaction analytics on Spark DataFrames."""
