"""Cohort risk analytics on Spark DataFrames, Spark ML and Structured Streaming."""
