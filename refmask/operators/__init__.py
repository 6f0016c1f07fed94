"""Operators: DataFrames of scripts in, DataFrames out."""
