"""Operators over Spark DataFrames."""
