"""Facets over streams."""
