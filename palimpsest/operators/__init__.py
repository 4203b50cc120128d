"""Operators: DataFrames in, DataFrames out, nothing collected on the way."""
