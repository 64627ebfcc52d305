"""Relational operators: DataFrames in, DataFrames out, no global state."""
