"""Content-addressed archive analytics and training-data preparation on Spark DataFrames."""
