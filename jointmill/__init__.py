"""Spark-native operators for annotated-image datasets and classifier evaluation."""

__version__ = "0.1.0"
