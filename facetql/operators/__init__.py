"""Logical queries as DataFrames."""
