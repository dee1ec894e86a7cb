"""Column functions: plain Spark expressions without state."""
