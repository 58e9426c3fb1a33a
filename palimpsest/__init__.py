"""Versioned-file catalog analytics on Spark."""
