"""Session analytics on Spark: recorded agent conversations and tool traces as DataFrames."""

__version__ = "0.1.0"
