"""The operators: each takes DataFrames and an Engine and returns a DataFrame."""
