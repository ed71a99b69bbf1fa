"""Spark-native analytics for cache traces, hash placement, inventories and ranked boards."""

__version__ = "0.1.0"
