"""Survey and grid analytics on Spark DataFrames."""
