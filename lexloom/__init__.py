"""lexloom: spelling and morphology analytics on Spark DataFrames."""
