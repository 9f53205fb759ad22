"""flowloom: analytics over IP flow records, planned as ordinary Spark DataFrames."""

__version__ = "0.1.0"
