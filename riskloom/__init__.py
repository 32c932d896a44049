"""Relationship-risk analytics on Spark DataFrames."""
