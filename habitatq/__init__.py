"""Habitat-preference analytics for biological survey data, on Spark DataFrames."""
