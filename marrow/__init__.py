"""marrow: typed document models, queries and replication, compiled to Spark DataFrames."""
