"""Event detection over sequences, on Spark DataFrames."""
