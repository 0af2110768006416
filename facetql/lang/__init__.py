"""The query language: text to syntax tree, on the driver, without Spark."""
