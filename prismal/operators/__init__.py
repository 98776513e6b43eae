"""Operators that build DataFrames: queries, migration, nesting, inserts, validation and costs."""
