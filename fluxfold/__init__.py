"""Spark-native analytics for periodic-event time series."""

__version__ = "0.1.0"
