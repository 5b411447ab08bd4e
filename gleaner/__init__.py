"""Gleaner: exact and near-duplicate analytics on Spark DataFrames."""
