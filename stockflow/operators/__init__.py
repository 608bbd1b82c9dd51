"""Inventory operators: DataFrames in, DataFrames out."""
