"""Spark-native analytics for ocean wave spectra."""

__version__ = "0.1.0"
