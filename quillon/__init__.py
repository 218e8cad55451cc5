"""A Spark-native engine for directories of files, nested values and incremental runs."""

__version__ = "0.1.0"
