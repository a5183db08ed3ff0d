"""millrace: time-series association screening on Spark DataFrames."""
