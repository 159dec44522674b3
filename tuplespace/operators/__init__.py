"""DataFrame operators: each takes and returns DataFrames, nothing is collected."""
