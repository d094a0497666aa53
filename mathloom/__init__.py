"""Datasets of symbolic computation problems as Spark DataFrames."""
