"""Evaluation, label audit and selection operators for Spark DataFrames."""
