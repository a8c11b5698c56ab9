"""Spark-native analytics for animal tracking and neural position decoding tables."""

__version__ = "0.1.0"
