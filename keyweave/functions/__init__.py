"""Column expressions and type tables."""
