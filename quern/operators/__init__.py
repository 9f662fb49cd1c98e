"""Operators from DataFrames to DataFrames, keyed on ids."""
