"""Sales review and workload analytics on Spark DataFrames."""
