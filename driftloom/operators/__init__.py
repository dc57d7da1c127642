"""Operators on panels: DataFrames of many series with key columns, a time and values."""
