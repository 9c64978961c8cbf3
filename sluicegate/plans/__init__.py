"""Whole jobs built from the operators: outcomes, store, imports."""
