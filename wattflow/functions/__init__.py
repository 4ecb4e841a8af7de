"""Column expressions (built-in Spark functions only, so they stay in codegen)."""
