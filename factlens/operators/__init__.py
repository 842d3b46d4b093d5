"""Operators of the core, as functions from DataFrames to DataFrames."""
