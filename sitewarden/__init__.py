"""Workplace-safety analytics on Spark DataFrames."""
