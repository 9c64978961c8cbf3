"""Column functions: native expressions, no Python on the row path."""
