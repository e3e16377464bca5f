"""Column functions. All stay inside Spark's expression engine."""
