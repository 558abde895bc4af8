"""Strata: analytics and data-engineering operators on Spark DataFrames and streams."""

__version__ = "0.1.0"
