"""Column expressions and distributed rank / quantile helpers."""
