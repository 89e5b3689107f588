"""Chinese-text, learning-log and page-geometry analytics on Spark DataFrames."""

__version__ = "0.1.0"
