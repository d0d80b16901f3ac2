"""Document-text analytics on Spark DataFrames."""
