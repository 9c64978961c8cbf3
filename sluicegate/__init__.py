"""Batch intake, data quality and reconciliation over Spark DataFrames."""
