"""Expressions as Spark columns: per-row metrics and null-safe filters."""
