"""Relational operators over usage logs: DataFrames in, DataFrames out."""
