"""warraq: corpus evaluation and curation operators on Spark DataFrames."""

__version__ = "0.1.0"
