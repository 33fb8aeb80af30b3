"""gridmill: printed statistical tables to checked, coded observations, on Spark DataFrames."""

__version__ = "0.1.0"
