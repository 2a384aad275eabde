"""cairn: content-addressed snapshot analytics on Spark DataFrames."""
