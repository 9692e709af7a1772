"""Chat-log analytics and corpus preparation on Spark DataFrames."""
