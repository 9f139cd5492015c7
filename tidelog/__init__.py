"""Log and event analytics on Spark DataFrames."""
