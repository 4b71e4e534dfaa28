"""Assessment analytics on Spark DataFrames."""
