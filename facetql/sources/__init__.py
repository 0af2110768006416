"""Datasets and the catalog that names them."""
