"""coplex: co-occurrence analytics on Spark DataFrames."""
