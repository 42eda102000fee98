"""Scalar functions as Column expressions, and formatting at the edge."""
