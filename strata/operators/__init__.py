"""DataFrame operators: each takes DataFrames and plain settings and returns a DataFrame."""
