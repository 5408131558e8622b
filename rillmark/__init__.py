"""Event-time stream processing and batch relational queries on Spark DataFrames."""
