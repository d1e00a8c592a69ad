"""labelsift: label-filtered vector search and its analytics as Spark DataFrames."""

__version__ = "0.1.0"
