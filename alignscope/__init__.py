"""Spark-native analytics for aligning banks of numeric signals with human-labelled concepts."""

__version__ = "0.1.0"
