"""Point-in-time analytics on Spark: operators from DataFrames to DataFrames."""
