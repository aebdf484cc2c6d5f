"""Spark-native catalog and analytics engine for vintage-computer media."""

__version__ = "0.1.0"
