"""Column functions: native Spark SQL expressions, no Python per row."""
