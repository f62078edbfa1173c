"""millrace: declarative data pipelines, data quality and analytics on Spark DataFrames."""

__version__ = "0.1.0"
