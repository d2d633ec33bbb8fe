"""Ordered-activity analytics on Spark: normalising, features, ranking metrics and training-data preparation."""

__version__ = "0.1.0"
