"""Point-in-time research analytics on Spark DataFrames."""
