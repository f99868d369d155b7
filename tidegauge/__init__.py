"""Recording-quality analytics on Spark DataFrames."""
