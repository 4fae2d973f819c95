"""Tamarack: a PySpark-native engine for streaming-translation training data."""

__version__ = "0.1.0"
