"""factloom: evidence-anchored analytics on Spark DataFrames."""
