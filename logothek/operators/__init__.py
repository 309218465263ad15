"""Operators: each takes and returns DataFrames and never collects rows of unbounded number."""
