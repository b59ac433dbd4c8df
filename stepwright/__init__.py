"""Step-level reward analytics and corpus preparation on Spark DataFrames."""
