"""Scalar functions on columns and names."""
