"""Emberline: a PySpark-native engine for interaction logs and preference data."""

__version__ = "0.1.0"
