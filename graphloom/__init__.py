"""Property-graph analytics as Spark DataFrames."""
