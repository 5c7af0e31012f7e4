"""Web and traffic analytics on Spark DataFrames."""
