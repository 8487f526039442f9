"""Operators on domain tables: DataFrames in, DataFrames out."""
