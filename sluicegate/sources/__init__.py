"""Readers: landing folders, workbooks, file fingerprints."""
