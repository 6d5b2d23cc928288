"""Timeline and evidence analytics on Spark DataFrames."""
