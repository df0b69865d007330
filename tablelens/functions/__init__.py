"""Column expressions and plain helpers."""
