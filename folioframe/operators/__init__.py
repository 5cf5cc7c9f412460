"""Operators over record tables: DataFrames in, DataFrames out."""
