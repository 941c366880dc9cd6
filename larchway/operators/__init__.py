"""Relational operators: DataFrames in, DataFrames out; none touches storage."""
