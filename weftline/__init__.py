"""weftline: deterministic training-data plans on Spark DataFrames."""

__version__ = "0.1.0"
