"""Operators: DataFrame to DataFrame, keyed by the columns that name a table."""
