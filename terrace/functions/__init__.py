"""Column expressions and metrics."""
