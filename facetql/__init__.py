"""facetql: faceted aggregation over event-like datasets, compiled to Spark DataFrames."""

__version__ = "0.1.0"
