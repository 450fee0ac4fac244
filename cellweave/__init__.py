"""Cellweave: grids, series, attribute tables and training text as Spark DataFrames."""
