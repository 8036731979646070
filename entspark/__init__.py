"""Entity-level change and dependency analysis on Spark DataFrames."""
