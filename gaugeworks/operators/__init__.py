"""Operators: each takes and returns DataFrames, names its columns by parameter and keeps no state."""
