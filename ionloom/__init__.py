"""A PySpark-native engine for single-cell signal data."""

__version__ = "0.1.0"
