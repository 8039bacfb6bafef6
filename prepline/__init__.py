"""PySpark-native preparation, screening and profiling of tabular data."""

__version__ = "0.1.0"
