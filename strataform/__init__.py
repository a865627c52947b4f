"""Strataform: a Spark-native engine for versioned, checksummed, selectively readable tables."""

__version__ = "0.1.0"
