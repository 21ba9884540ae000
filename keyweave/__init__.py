"""Find, combine and check data that is spread over many tables, on Spark DataFrames."""
