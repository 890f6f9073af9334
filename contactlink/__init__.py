"""contactlink: contact-record deduplication and quality scoring on Spark DataFrames."""

__version__ = "0.1.0"
