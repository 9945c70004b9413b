"""Column expressions and Arrow-backed scalar functions."""
