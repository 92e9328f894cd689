"""Spark-native listing-price analytics."""
__version__ = "0.1.0"
