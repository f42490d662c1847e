"""Stable, sparse model inference on Spark DataFrames."""
