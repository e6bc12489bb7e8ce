"""Daily settlement-rent analytics on Spark DataFrames."""
