"""Column expressions and shared helpers."""
