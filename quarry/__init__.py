"""quarry — repository-ingestion analytics as Spark DataFrame and Structured Streaming jobs.

Every public job is a function from DataFrames to DataFrames; it performs no action,
holds no global session and takes clocks, limits and thresholds as parameters.
"""

__version__ = "0.1.0"
