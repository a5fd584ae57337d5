"""Record conversion and transformation on Spark DataFrames."""

__version__ = "0.1.0"
