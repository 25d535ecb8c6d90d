"""symloom: code-graph analytics on Spark DataFrames."""
