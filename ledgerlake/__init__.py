"""Versioned key/value and log data on Spark DataFrames."""
