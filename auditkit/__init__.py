"""Auditing of tabular prediction data on Spark DataFrames."""
