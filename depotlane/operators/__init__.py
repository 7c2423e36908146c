"""Operators over stock, picking and forecast tables: DataFrames in, a DataFrame out."""
