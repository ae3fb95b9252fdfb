"""Semi-structured and text analytics on Spark DataFrames."""
