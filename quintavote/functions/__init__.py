"""Column expressions and the small array helpers used inside tasks."""
