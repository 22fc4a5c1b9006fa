"""Plan builders: each function takes DataFrames and returns a DataFrame."""
