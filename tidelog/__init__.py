"""Log and evidence analytics on Spark DataFrames."""
