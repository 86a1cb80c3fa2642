"""Influence maximization and uncertain-graph analytics on Spark DataFrames."""
