"""The operators on solution sequences, each from DataFrames to a DataFrame."""
