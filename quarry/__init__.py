"""A JSON-driven analytics query engine on Spark DataFrames."""
