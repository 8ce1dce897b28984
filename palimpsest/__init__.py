"""Version-history analytics on Spark DataFrames."""
