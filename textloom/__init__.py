"""Document retrieval and overlap analytics on Spark DataFrames."""
