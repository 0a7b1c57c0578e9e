"""Column functions built from Spark's own, so that they stay in generated code."""
