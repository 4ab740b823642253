"""turnloom: speech turn-timing analytics on Spark DataFrames."""
