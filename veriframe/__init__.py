"""Analytic operators over communication records, expressed as Spark DataFrames."""
