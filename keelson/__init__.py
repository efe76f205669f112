"""Keelson: declare table contracts, bind them to Spark DataFrames, and run them as plans."""

__version__ = "0.1.0"
