"""Evidence-and-evaluation analytics on Spark DataFrames."""
