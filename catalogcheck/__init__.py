"""Product-catalog verification and corpus preparation on Spark DataFrames."""
