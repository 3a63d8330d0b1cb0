"""Training-data operators: text, page and token jobs that run as Spark DataFrames."""
