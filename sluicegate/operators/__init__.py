"""Relational operators: validation, duplicates, profiling, keyed changes, reports."""
