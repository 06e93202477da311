"""Document analytics and retrieval over Spark DataFrames."""
