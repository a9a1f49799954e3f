"""Preparing, checking and evaluating ranking data with PySpark DataFrames."""
