"""srcgraph: code-intelligence analytics on Spark DataFrames."""
