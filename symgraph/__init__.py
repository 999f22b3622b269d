"""Property-graph analytics over source symbols, expressed as Spark DataFrames."""
