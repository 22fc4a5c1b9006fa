"""Near-duplicate and copy detection over posts, planned as Spark DataFrames."""
