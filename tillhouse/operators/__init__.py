"""Reusable relational operators, each a function from DataFrames to a DataFrame."""
