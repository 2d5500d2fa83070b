"""Market-data and research-intelligence analytics on Spark DataFrames."""
